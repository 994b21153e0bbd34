"""Packing by concatenate and cut: two-pass prefix sums over partition token totals give every document its global
offset, then fixed windows are cut and a boundary record is written for every piece.

Pass 1 tokenises each document once and writes its ids with the partition's number and the document's offset in that
partition. The partitions' totals (one number each) go to the driver, whose running sum gives each partition its base.
Pass 2 adds base and local offset and cuts at multiples of the window. Only the last sequence can be short.

Null text counts as empty: such a document is its end id alone. Repeated rows are packed each for itself. An empty
table gives no pieces. Extra columns are ignored, whatever their names. Every text is tokenised whole; memory follows
the longest one. The written table makes a lost executor cost no second tokenisation.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORKER_CACHES, bytes_of, map_batches, struct, table, written

WINDOW, END_ID, TOKENIZER = 4096, 2, "word_bpe_49k.json"
#: Entries of a worker's word caches: one that keeps the first words seen (mostly frequent ones), one that is emptied when full.
KEPT_WORDS, YOUNG_WORDS, LONG_WORD = 300_000, 150_000, 64
_plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_loaded: dict[int, WholeIds] = WORKER_CACHES.setdefault("tokenizers", {})

# The settings of a tokenizer that lower-cases, drops white space and treats words by themselves.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WholeIds:
    """Ids of whole texts by any tokenizer, as bytes of unsigned 16-bit (or 32-bit) numbers."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def of(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()


class WordIds(dict, WholeIds):
    """The same where the tokenizer is ``_BY_WORD``: a text's ids are its words' ids in a row, and words are cached.

    Words of plain letters and then plain punctuation are put together from those two parts.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import pre_tokenizers

        WholeIds.__init__(self, tokenizer_json)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in [*range(97, 123), *range(0xDF, 0x100)] if i != 0xF7}
        self.young: dict[bytes, bytes] = {}

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.encoded(word.decode("utf-8", "replace"))
            if len(word) > LONG_WORD:
                return ids
            if len(self) < KEPT_WORDS:
                self[word] = ids
            else:
                if len(self.young) >= YOUNG_WORDS:
                    self.young.clear()
                self.young[word] = ids
        return ids

    def encoded(self, word: str) -> bytes:
        parts = _plain.fullmatch(word)
        if not parts:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        core, rest = parts.groups()
        low = core.lower()
        if rest or low != word:
            return self[low.encode()] + (self[rest.encode()] if rest else b"")
        return np.array([t.id for t in self.tokenizer.model.tokenize(low.translate(self.letters))], self.dtype).tobytes()


def ids_by(tokenizer_json: str, end_id: int) -> WholeIds:
    """A worker's loaded tokenizer; word by word where its settings allow that, else text by text."""
    key = hash((tokenizer_json, end_id))
    if key not in _loaded:
        spec = json.loads(tokenizer_json)
        by_word = all(spec.get(k) == v for k, v in _BY_WORD.items()) and spec["model"]["type"] == "BPE"
        _loaded[key] = (WordIds if by_word else WholeIds)(tokenizer_json)
        if end_id >= 1 << 8 * _loaded[key].dtype.itemsize:
            _loaded[key].dtype = np.dtype("<u4")
    return _loaded[key]


TOKENS = struct(part="int", doc_id="long", start="long", n="long", ids="binary")
PIECES = struct(doc_id="long", start="long", length="long", doc_tokens="long", sequence_id="long", offset="long", ids="binary")


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Rows (part, doc_id, start, n, ids): ids as unsigned 32-bit or, for small vocabularies, 16-bit numbers; start is the offset in the partition."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    done: dict[int, int] = {}  # of this task: tokens so far by partition

    def fn(batch: pa.RecordBatch) -> dict:
        tokenizer = ids_by(shipped.value, end_id)
        end = np.array([end_id], tokenizer.dtype).tobytes()
        ids = [tokenizer.of(t) + end for t in bytes_of(batch)]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // tokenizer.dtype.itemsize
        part = batch.column("part")[0].as_py()
        start = done.get(part, 0) + np.cumsum(n) - n
        done[part] = int(start[-1] + n[-1])
        return {"part": batch.column("part"), "doc_id": batch.column("doc_id").cast(pa.int64()), "start": start, "n": n, "ids": ids}

    return map_batches(docs.select(F.spark_partition_id().alias("part"), "doc_id", "text"), fn, TOKENS, keep="tokenizers")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence; ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers."""
    tokens = written(tokenize(docs, tokenizer_path, end_id), "tokens")
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a number per input partition
    base, run = {}, 0
    for part, n in totals:
        base[part] = run
        run += n
    bases = docs.sparkSession.sparkContext.broadcast(base)

    def fn(batch: pa.RecordBatch) -> dict:
        begin = np.array([bases.value[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("start").to_numpy()
        n = batch.column("n").to_numpy()
        first, last = begin // window, (begin + n - 1) // window
        pieces = (last - first + 1).astype(np.int64)
        row = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        seq = first[row] + nth
        lo = np.maximum(begin[row], seq * window)
        hi = np.minimum(begin[row] + n[row], (seq + 1) * window)
        start, length = lo - begin[row], hi - lo
        ids, at, now = [], -1, np.empty(0)
        for r, a, b in zip(row.tolist(), start.tolist(), (start + length).tolist()):
            if r != at:
                raw = batch.column("ids")[r].as_py()
                at, now = r, np.frombuffer(raw, f"<u{len(raw) // int(n[r])}").astype("<u4")
            ids.append(now[a:b].tobytes())
        return {"doc_id": batch.column("doc_id").take(pa.array(row)), "start": start, "length": length, "doc_tokens": n[row], "sequence_id": seq, "offset": lo - seq * window, "ids": ids}

    return map_batches(tokens, fn, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
