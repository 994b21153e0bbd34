"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, token windows scanned against it, hits
verified word by word, then documents or spans removed.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ``n`` consecutive item words; an
item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

The index (normalised item texts, window hashes, items by window) is broadcast while ``MAX_INDEX_BYTES`` bounds it. Beyond
that a sieve of the windows' hashes, bounded whatever their number, picks the document windows that may hit; these alone
meet the benchmark's windows in a shuffle join on hash and words, with the same results.

Null texts have no words; null or wordless items have no window. Repeated documents are each reported; items that share
a window are all counted; repeated item ids count once. An empty table of documents gives an empty result, an empty
benchmark no hits. Extra columns are kept by ``decontaminate`` and ignored by ``find_contamination``. Texts are scanned
whole; memory follows the longest one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bytes_of, map_batches, rolling, sieve, struct, table, word_hashes, written

N, MAX_INDEX_BYTES = 10, 128 << 20
#: Every byte as the word rule sees it: capitals become small letters, what is in no word becomes a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of the index for each benchmark word beside the word itself: its window's hash, bounds and item, and 32 flags.
_WORD_BYTES = 64


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TO_WORDS).split()


class WindowIndex:
    """The hash set: windows by length and hash, with the place of their words and the items that hold them."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        self.items = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.items)}
        joined, places, found, at = [], [], [], 0
        for name, text in items:
            words = words_of((text or "").encode())
            if not words:
                continue
            size = np.fromiter(map(len, words), np.int64, len(words))
            first = at + np.cumsum(size + 1) - size - 1
            k = min(n, len(words))
            line = b" ".join(words)
            hashes = rolling(word_hashes(line), k)
            found.append((np.full(len(hashes), k), hashes, first[: len(hashes)], (first + size)[k - 1 :], np.full(len(hashes), number[name])))
            joined.append(line)
            at += len(line) + 1
        self.text = b" ".join(joined)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        if not found:
            return
        length, hashes, first, end, item = (np.concatenate(x) for x in zip(*found))
        for k in np.unique(length).tolist():
            here = np.flatnonzero(length == k)
            here = here[np.lexsort((item[here], hashes[here]))]
            bits = max(8, len(here).bit_length() + 4)
            maybe = np.zeros(1 << bits, bool)  # one look at it tells nearly every window that is not there
            maybe[(hashes[here] >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[k] = hashes[here], first[here], end[here], item[here].astype(np.int32), maybe, np.uint64(64 - bits)

    def scan(self, raw: bytes) -> tuple[int, np.ndarray | None, set[int]]:
        """Number of words, the hit words (None: none) and the items of verified occurrences."""
        line = raw.translate(_TO_WORDS)
        ids = word_hashes(line)
        cover, items, words = None, set(), None
        for k, (hashes, first, end, item, maybe, shift) in self.tables.items():
            h = rolling(ids, k)
            here = np.flatnonzero(maybe[(h >> shift).astype(np.int64)])
            if not len(here):
                continue
            low, high = np.searchsorted(hashes, h[here], "left"), np.searchsorted(hashes, h[here], "right")
            for j in np.flatnonzero(high > low).tolist():
                p = int(here[j])
                words = line.split() if words is None else words
                window = b" ".join(words[p : p + k])
                for w in range(int(low[j]), int(high[j])):
                    if self.text[first[w] : end[w]] == window:
                        items.add(int(item[w]))
                        cover = np.zeros(len(ids), bool) if cover is None else cover
                        cover[p : p + k] = True
        return len(ids), cover, items


HITS = struct(doc_id="long", n_words="long", n_hit="long", n_items="long", items_sha256="string", contaminated="boolean")


def _sha(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _index(benchmark: DataFrame, n: int, max_bytes: int):
    """The broadcast index, or None where its size is over the bound."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64 + F.octet_length("item_id") + _WORD_BYTES * F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD_PATTERN)))).first()[0] or 0
    if size > max_bytes:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(WindowIndex([(r.item_id, r.text) for r in items.collect()], n))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    shipped = _index(benchmark, n, max_index_bytes)
    if shipped is None:
        return _found_by_join(docs, benchmark, n)

    def fn(batch: pa.RecordBatch) -> dict:
        index, rows = shipped.value, []
        for raw in bytes_of(batch):
            n_words, hit, items = index.scan(raw)
            rows.append((n_words, 0 if hit is None else int(hit.sum()), len(items), _sha([index.items[i] for i in items]), hit is not None))
        return {"doc_id": batch.column("doc_id").cast(pa.int64())} | dict(zip(HITS.names[1:], map(list, zip(*rows))))

    return map_batches(docs.select("doc_id", "text"), fn, HITS)


_WINDOWS = struct(hash="long", k="int", words="binary", item="string")
_MAYBE = struct(row="long", hash="long", k="int", at="int", words="binary")


def _joined(numbered: DataFrame, benchmark: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(row, at, k, hash, words) of the windows of ``numbered`` (row, text) that the benchmark has, and its (hash, words, item)."""

    def windows(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in _WINDOWS.names}
        for item, raw in zip(batch.column("item").to_pylist(), bytes_of(batch)):
            words = words_of(raw)
            k = min(n, len(words))
            for i, h in enumerate(rolling(word_hashes(b" ".join(words)), k).view(np.int64).tolist() if k else ()):
                for c, v in zip(_WINDOWS.names, (h, k, b" ".join(words[i : i + k]), item)):
                    out[c].append(v)
        return out

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
    held = written(map_batches(items, windows, _WINDOWS).distinct(), "windows")
    lengths = sorted(r.k for r in held.select("k").distinct().collect())  # n at most
    distinct = held.select("hash", "k", "words").distinct()
    shipped = sieve(held.select("hash"), held.count())

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in zip(batch.column("row").to_pylist(), bytes_of(batch)):
                line = raw.translate(_TO_WORDS)
                ids, words = word_hashes(line), None
                for k in lengths:
                    h = rolling(ids, k)
                    at = np.flatnonzero(shipped.value.has(h)) if len(h) else h
                    if len(at):
                        words = line.split() if words is None else words
                        cols = [row] * len(at), h[at].view(np.int64), [k] * len(at), at.astype(np.int32), [b" ".join(words[p : p + k]) for p in at.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=_MAYBE.names)

    hits = numbered.select("row", "text").mapInArrow(maybe, _MAYBE).join(distinct, ["hash", "k", "words"])
    return written(hits, "hits"), held.select("hash", "k", "words", "item")


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as (row, d: its columns, text), written so that a row keeps its number."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("d"), "text"), "numbered")


def _positions(hits: DataFrame) -> DataFrame:
    """(row, at): the hit words."""
    return hits.select("row", F.explode(F.expr("sequence(at, at + k - 1)")).alias("at")).distinct()


def _found_by_join(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    numbered = _numbered(docs.select("doc_id", "text"))
    hits, held = _joined(numbered, benchmark, n)
    cover = _positions(hits).groupBy("row").agg(F.count("*").alias("n_hit"))
    found = hits.select("row", "hash", "k", "words").distinct().join(held, ["hash", "k", "words"]).select("row", "item").distinct()
    found = found.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    sizes = map_batches(numbered.select("row", "d.doc_id", "text"), lambda batch: {"row": batch.column("row"), "doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": [len(words_of(r)) for r in bytes_of(batch)]}, struct(row="long", doc_id="long", n_words="long"))
    zero = F.lit(0).cast("long")
    both = sizes.join(cover, "row", "left").join(found, "row", "left")
    return both.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(_sha([]))).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = N, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) with hit words cut from their texts; same columns."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove: documents or spans")
    shipped = _index(benchmark, n, max_index_bytes)
    if shipped is None:
        numbered = _numbered(docs)
        hits, _ = _joined(numbered, benchmark, n)
        if remove == "documents":
            return numbered.join(hits.select("row").distinct(), "row", "left_anti").select("d.*")
        places = _positions(hits).groupBy("row").agg(F.collect_list("at").alias("at"))
        marked = numbered.join(places, "row", "left").select("d.*", "at")
        hit_column, source = len(docs.columns), marked
    else:
        hit_column, source = None, docs
    names = docs.columns

    def fn(batch: pa.RecordBatch) -> dict:
        keep, texts = [], []
        for i, (raw, text) in enumerate(zip(bytes_of(batch), batch.column(names.index("text")))):
            if hit_column is None:
                hit = shipped.value.scan(raw)[1]
            else:
                at = batch.column(hit_column)[i].as_py()
                hit = None if at is None else np.isin(np.arange(len(words_of(raw))), at)
            keep.append(hit is None or remove == "spans")
            if keep[-1]:
                texts.append(text.as_py() if hit is None else _cut(raw, hit))
        rest = batch.filter(pa.array(keep, pa.bool_()))
        out = dict(zip(names, rest.columns)) | {"text": texts}
        return out | ({"n_chars": [None if t is None else len(t) for t in texts]} if "n_chars" in names and remove == "spans" else {})

    return map_batches(source, fn, docs.schema)


def _cut(raw: bytes, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between two of them."""
    spans = [m.span() for m in _WORD.finditer(raw)]
    out, at, i = [], 0, 0
    while i < len(spans):
        if hit[i]:
            j = i
            while j + 1 < len(spans) and hit[j + 1]:
                j += 1
            out.append(raw[at : spans[i][0]])
            at, i = spans[j][1], j
        i += 1
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, ws, least({N}, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT rid, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hits GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, cov.n IS NOT NULL AS contaminated
FROM d LEFT JOIN cov ON d.rid = cov.rid LEFT JOIN it ON d.rid = it.rid
"""
