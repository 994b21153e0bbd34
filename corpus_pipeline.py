"""From raw documents to packed sequences: quality rules, near-dedup, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns as Parquet into the shared folder and hands
the reread table to the next. All but the last return the columns of ``documents``.

For every stage: a null text counts as empty (it has no words, so ``quality`` rejects it; the later stages keep it as it
is). Rows without a doc_id cannot be named, so ``near_dedup`` keeps them all; rows of one doc_id are one document there,
that of the smallest text stays; elsewhere repeated rows are handled one by one. Of a group of near copies the smallest
doc_id stays, so ties cannot occur. An empty table gives an empty table, an empty benchmark removes nothing. Further
columns of ``documents`` are carried to the last stage but one, whatever their names. Texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depquarry.llm import decontaminate, packing, pii, quality, simhash
from depquarry.llm._common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then rejected documents."""
    return quality.clean_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.digest(packing.pack(docs, packing.default_tokenizer()))


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", redaction), ("packing", packed)]

#: Packing by a subword tokenizer has no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
