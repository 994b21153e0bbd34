"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import ctypes
import math
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..storage import NO_SHUFFLES_LEFT, scratch_path, shared_dir

__all__ = ["NO_SHUFFLES_LEFT", "scratch_path", "shared_dir"]

#: Rows and bytes of the Arrow batches of what is written on the way, so that a task's Python side stays small.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"


#: The most that Spark may size a table at and broadcast it unasked. It sizes a table by its file and takes no row for
#: more than one behind an explode or a map over Arrow batches, so what it sizes at some MB can be a thousand times that.
UNASKED_BROADCAST = 256 << 10


def _bytes(size: str) -> int:
    """Bytes of a Spark setting such as ``10m``."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", size.strip().lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit[:1], 0)


def written(df: DataFrame, name: str, settings: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """``storage.written`` with small Arrow batches, no large table broadcast unless the plan asks for it, and ``settings``;
    the session's own settings come back afterwards."""
    conf = df.sparkSession.conf
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES} | (settings or {})
    keys["spark.sql.autoBroadcastJoinThreshold"] = str(min(UNASKED_BROADCAST, _bytes(conf.get("spark.sql.autoBroadcastJoinThreshold"))))
    before = {k: conf.get(k, "false") if k in NO_SHUFFLES_LEFT else conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            conf.set(k, v)
        return storage.written(df, name, by) if by else storage.written(df, name)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


#: What a worker keeps from task to task (loaded tokenizers and their words), by name. Spark hands a worker on to the
#: next stage, so tasks that do not ask for a cache drop it.
WORKER_CACHES: dict[str, dict] = {}


def drop_caches(keep: str = "") -> None:
    for name, cache in WORKER_CACHES.items():
        if name != keep:
            cache.clear()


def give_back() -> None:
    """Memory that is free in this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType, keep: str = "") -> DataFrame:
    """``fn`` turns one Arrow batch into columns (name -> list or array) of ``schema``. Spark bounds a batch by rows and bytes.
    ``keep`` names the worker cache that ``fn`` uses."""
    names = [f.name for f in schema]
    types = [arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(keep)
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                arrays = [c if isinstance(c, pa.Array) and c.type == t else pa.array(c, t) for c, t in ((cols[n], t) for n, t in zip(names, types))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return df.mapInArrow(run, schema)


def struct(**fields: str) -> T.StructType:
    """``struct(doc_id='long', text='string')``."""
    kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "binary": T.BinaryType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType()), "array<long>": T.ArrayType(T.LongType()), "array<int>": T.ArrayType(T.IntegerType()), "array<double>": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The column's strings one by one, null as empty; only one is a Python object at a time."""
    for x in batch.column(name):
        yield x.as_py() or ""


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """As ``texts_of``, as UTF-8 bytes."""
    col = batch.column(name)
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())  # no copy of the data
    for x in col:
        yield x.as_py() or b""


#: A word's hash is a polynomial in its bytes modulo 2^64, so all words of a block come out of one running sum;
#: longer words are hashed by themselves.
_BLOCK, _LONG = 1 << 20, 256
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(_BLOCK + 1, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.cumprod(x))
        _POWERS.append(mix64(np.arange(1, 257, dtype=np.uint64)))
    return _POWERS


def _hash_block(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff((~_SPACE[b]).view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    size = end - start
    if len(raw) > _BLOCK:
        out = np.zeros(len(size), np.uint64)
    else:
        power, inverse, of_byte = _powers()
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(of_byte[b] * power[: len(raw)], out=total[1:])
        out = mix64((total[end] - total[start]) * inverse[start] + size.astype(np.uint64))
    for i in np.flatnonzero((size > _LONG) | (len(raw) > _BLOCK)).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]]) if size[i] > _LONG else _hash_block(raw[start[i] : end[i]])[0]
    return out


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\x20\x09-\x0D]+`` of a UTF-8 text, A-Z in lower case."""
    raw = raw.lower()
    if len(raw) <= _BLOCK:
        return _hash_block(raw)
    out, at = [], 0
    while at < len(raw):
        cut = len(raw) if len(raw) - at <= _BLOCK else max(raw.rfind(c, at, at + _BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < at:  # a word longer than a block
            ends = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := raw.find(c, at)) >= 0]
            cut = min(ends, default=len(raw))
        out.append(_hash_block(raw[at:cut]))
        at = cut + 1
    return np.concatenate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the windows of ``k`` consecutive ids (uint64, already scrambled)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    return mix64(h)


def runs_of(keys: list[np.ndarray]) -> np.ndarray:
    """Start offsets of the runs of equal keys in sorted columns, plus the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def map_sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[dict[str, list[np.ndarray]], np.ndarray], dict], schema: T.StructType, partitions: int | None = None, order: list[str] | None = None, where: str = "") -> DataFrame:
    """Bring the rows of a key together and hand ``fn`` many whole groups at once as numpy columns.

    One shuffle and one sort; a Python call covers all groups of an Arrow batch, so that millions of small groups cost
    little. ``fn(columns, starts)``: numpy columns and the offsets at which groups begin, plus the end. The caller
    bounds a group's size: only one group more than a batch is held.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f.name for f in schema]
    types = [arrow_type(f.dataType) for f in schema]

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts)
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        out = fn(cols, runs_of([cols[k] for k in keys]))
        return pa.RecordBatch.from_arrays([pa.array(out[c], ty) for c, ty in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            last = int(runs_of(cols)[-2])  # where the last group begins
            same = held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if last == 0 and same:
                held.append(batch)
                continue
            if last:
                held.append(batch.slice(0, last))
            if held:
                yield flush(held)
            held = [batch.slice(last)]
        if held:
            yield flush(held)
        held.clear()
        give_back()

    cols = [F.col(c) for c in keys]
    return df.repartition(n, *cols).sortWithinPartitions(*cols, *[F.col(c) for c in order or []]).mapInArrow(run, schema)


#: Keys of a thousandth of all rows or more are a thousand at most.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, named: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``named``, which has one row a key and, as ``weight``, how many rows of ``rows`` about
    meet it. The keys of a thousandth of the weight or more, a thousand at most, are listed and broadcast; the rest is
    shuffled."""
    hot = F.col(weight) * HOT_SHARE >= (named.agg(F.sum(weight)).first()[0] or 0)
    listed = [tuple(r) for r in named.filter(hot).select(*on).collect()]
    if not listed:
        return rows.join(named.drop(weight), on)
    key = F.col(on[0]) if len(on) == 1 else F.struct(*on)
    among = key.isin([F.lit(x[0]) if len(on) == 1 else F.struct(*[F.lit(v).alias(c) for v, c in zip(x, on)]) for x in listed])
    return rows.filter(among).join(F.broadcast(named.filter(hot).drop(weight)), on).unionByName(rows.filter(~among).join(named.filter(~hot).drop(weight), on))


SIEVE_BITS, _SEGMENTS, _SMALL_BITS = 31, 8, 27  # 256 MB at most; small: 16 MB


class Sieve:
    """A bit for each of 2^bits ranges of scrambled keys; it never denies a key that was put in."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.shift = np.uint64(64 - bits)
        empty = bytes((1 << bits - _SEGMENTS) // 8)
        self.bytes = np.frombuffer(b"".join(parts.get(i, empty) for i in range(1 << _SEGMENTS)), np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = mix64(keys) >> self.shift
        return self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def sieve(keys: DataFrame, n: int, max_bits: int = SIEVE_BITS):
    """A broadcast sieve of a column of ``n`` longs, 16 bits to a key as long as ``max_bits`` allow that. Its segments are
    filled by tasks; the driver sees these only."""
    bits = max(_SEGMENTS + 6, min(max_bits, math.ceil(math.log2(max(n, 1))) + 4))

    def scrambled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array((k >> np.uint64(64 - _SEGMENTS)).astype(np.int32)), pa.array(k.view(np.int64))], names=["segment", "key"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, key = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            order = np.argsort(segment, kind="stable")
            edges = runs_of([segment[order]])
            for a, b in zip(edges, edges[1:]):
                here = order[a:b]
                part = parts.setdefault(int(segment[here[0]]), np.zeros(1 << bits - _SEGMENTS, bool))
                part[(key[here] >> np.uint64(64 - bits) & np.uint64((1 << bits - _SEGMENTS) - 1)).astype(np.int64)] = True
        for s, part in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    spread = keys.mapInArrow(scrambled, struct(segment="int", key="long")).repartition("segment")
    segments = spread.mapInArrow(filled, struct(segment="int", bits="binary"))
    # a small sieve comes in one job, a large one partition by partition, a job each
    parts = {r.segment: bytes(r.bits) for r in (segments.collect() if bits <= _SMALL_BITS else segments.toLocalIterator())}
    return keys.sparkSession.sparkContext.broadcast(Sieve(bits, parts))
