"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, circulant, decontaminate, divergence, extract, lm, packing, passages, pii, prefixes, quality, simhash, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_pii": pii.op4_pii,
    "op5_html_extraction": extract.op5_html_extraction,
    "op6_simhash": simhash.op6_simhash,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_warc": warc.op8_warc,
    "op9_packing": packing.op9_packing,
    "op10_chat": chat.op10_chat,
    "op11_divergence": divergence.op11_divergence,
    "op12_circulant_minhash": circulant.op12_circulant_minhash,
    "op13_prefix_trie": prefixes.op13_prefix_trie,
}

ORACLES = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_circulant_minhash": circulant.OP12_SQL,
    "op13_prefix_trie": prefixes.OP13_SQL,
}
