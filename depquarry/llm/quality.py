"""Quality rules, line first: lines that break a rule go, then documents that lose too much text.

Lines are the ``\\n``-split pieces with at least one word (a run of characters other than the six ASCII white-space
characters). A line fails as

* symbols: over a tenth of its word characters are one of ``#*$%&|<>``;
* shouting: no ASCII small letter and ten or more ASCII capitals;
* navigation: three or more words that are separators, and these are a fifth of its words or more;
* boilerplate: 15 words or fewer and one of the phrases below (English, German, French, Spanish);
* punctuation: fewer than 10 words and no closing punctuation at its end.

A document is rejected if it fails the base rules (under 20 words; over 30 % of its words inside repeated 8-word
windows) or if over half of its word characters are in failing lines.

Null text counts as empty (no words: rejected). Repeated rows are judged one by one; ties cannot occur. An empty table
gives an empty table. Extra columns, whatever their names, are carried through by ``clean_lines`` and left out by
``measure_quality``. Texts are handled whole, one at a time, so memory follows the longest text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import map_batches, rolling, mix64, struct, table, texts_of

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", ">", "»", "·", "/")
BOILERPLATE = r"all rights reserved|terms of (use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|lorem ipsum|subscribe to our newsletter|click here|share on|sign in to|log in to|alle rechte vorbehalten|datenschutzerkl|newsletter abonnieren|tous droits r.serv|politique de confidentialit|accepter les cookies|todos los derechos reservados|pol.tica de privacidad|aceptar (las )?cookies"
CLOSING, CLOSERS = ".!?:;…。！？", "\"'”’»)]*"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MAX_LOST_PERCENT = 20, 30, 8, 50

_boiler, _lower, _words = re.compile(BOILERPLATE, re.I | re.A), re.compile("[a-z]"), re.compile(r"[^\x20\x09-\x0D]+")


def _chars(s: str) -> int:
    return len(s) - sum(map(s.count, SPACE))


def line_fails(line: str) -> bool:
    """Whether a line with at least one word breaks a rule."""
    chars = _chars(line)
    if 10 * sum(map(line.count, SYMBOLS)) > chars:
        return True
    if not _lower.search(line) and sum(1 for c in line if "A" <= c <= "Z") >= 10:
        return True
    if any(s in line for s in SEPARATORS):
        words = _words.findall(line)
        seps = sum(w in SEPARATORS for w in words)
        if seps >= 3 and 5 * seps >= len(words):
            return True
    closed = line.rstrip(SPACE).rstrip(CLOSERS)[-1:]
    if (not closed or closed not in CLOSING) and len(_words.findall(line)) < 10:
        return True
    return bool(_boiler.search(line)) and len(_words.findall(line)) <= 15


def repeat_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside windows of ``k`` words that occur twice or more in the text, first ones included."""
    n = len(words)
    if n <= k:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    h = rolling(mix64(ids), k)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = order[np.append(same, False) | np.append(False, same)]
    _, inverse, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, k)[hit], axis=0, return_inverse=True, return_counts=True)  # the hashes only propose
    hit = hit[counts[inverse.ravel()] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the lines that stay."""
    words = text.encode("utf-8", "replace").split()
    chars = _chars(text)
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(SPACE)]
    repeats = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    bad = {x for x in set(worded) if line_fails(x)}
    lost = sum(_chars(x) for x in worded if x in bad) if bad else 0
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * chars
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)), repeats, failed, kept, [x for x in lines if x not in bad] if bad else lines


MEASURES = struct(doc_id="long", n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long", base_failed="boolean", kept="boolean")


def measure_quality(docs: DataFrame) -> DataFrame:
    """One row of figures and the verdict per row of ``docs`` (doc_id, text)."""

    def fn(batch: pa.RecordBatch) -> dict:
        rows = [judge(t)[:7] for t in texts_of(batch)]
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | dict(zip(MEASURES.names[1:], map(list, zip(*rows))))

    return map_batches(docs.select("doc_id", "text"), fn, MEASURES)


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without failing lines and without rejected documents; same columns (``n_chars`` follows the new text)."""
    names = docs.columns

    def fn(batch: pa.RecordBatch) -> dict:
        keep, texts = [], []
        for t in texts_of(batch):
            *_, kept, lines = judge(t)
            keep.append(kept)
            if kept:
                texts.append("\n".join(lines))
        rest = batch.filter(pa.array(keep, pa.bool_()))
        out = dict(zip(names, rest.columns)) | {"text": texts}
        return out | ({"n_chars": [len(t) for t in texts]} if "n_chars" in names else {})

    return map_batches(docs, fn, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_quality(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, {_WORDS.format('t')} AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
rep AS (SELECT rid, i FROM win WHERE (rid, g) IN (SELECT (rid, g) FROM win GROUP BY rid, g HAVING count(*) > 1)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, l, {_WORDS.format('l')} AS lw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
lj AS (SELECT rid, l, length(array_to_string(lw, '')) AS c,
  10 * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > length(array_to_string(lw, ''))
  OR (NOT regexp_matches(l, '[a-z]') AND length(regexp_replace(l, '[^A-Z]', '', 'g')) >= 10)
  OR (len(list_filter(lw, lambda x: x IN ('|', '>', '»', '·', '/'))) >= 3 AND 5 * len(list_filter(lw, lambda x: x IN ('|', '>', '»', '·', '/'))) >= len(lw))
  OR (len(lw) < 10 AND NOT regexp_matches(lw[-1], '[.!?:;…。！？]["''”’»)\]*]*$'))
  OR (len(lw) <= 15 AND regexp_matches(l, '{BOILERPLATE}', 'i')) AS bad
  FROM ln WHERE len(lw) > 0),
la AS (SELECT rid, count(*) - count(DISTINCT l) AS dup, sum(CASE WHEN bad THEN c ELSE 0 END) AS lost FROM lj GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN cov ON w.rid = cov.rid LEFT JOIN la ON w.rid = la.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM m
"""
