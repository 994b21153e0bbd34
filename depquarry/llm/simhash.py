"""SimHash near duplicates by bit-sliced comparison.

A fingerprint bit is 1 if set in over half of the XXH64 hashes of a text's 3-word shingles. Two fingerprints link at
``RADIUS`` or fewer differing bits. The 64 bits are cut into six blocks; two fingerprints that differ in at most three
bits agree on at least three blocks, so they share one of the 20 keys made of three blocks: no link is lost. Inside a
key's rows the fingerprints are stored as bit planes (64 lanes to a word); a query is compared with 64 lanes at once,
differing bits are counted by carry-save counters, and a block of lanes is abandoned once all exceed the radius.

Only distinct fingerprints are compared, so exact copies cost nothing; a key with more than ``CHUNK`` fingerprints is
dealt out as pairs of chunks; each compared group reports a spanning forest, never all its pairs. In large groups a few
leaders are compared first; lanes that they bring together are laid side by side, and a block of lanes that all belong
to the query's own component is not compared again.

``similar_documents`` proposes groups of a Jaccard similarity of 0.8 or more of the 5-word shingles: 256 bits of the
distinct shingles, of which similarity 0.8 differs in 39 on average, compared the same way at ``WIDE_RADIUS``. At that
radius no few blocks must agree, so keys are ``KEY_ROUNDS`` deals of the 256 bits into keys of ``KEY_BITS``; the README
states the share of pairs found by similarity. ``KEY_BITS`` sets how many strangers meet in a key: on far more than 2^24
distinct texts take more bits and more deals. ``verified_documents`` then compares the whole sets inside a proposed group
and keeps the links that hold, so that ``deduplicate`` drops no document without a link of 0.8 or more.

Null text counts as empty (fingerprint zero, linked like any other). Repeated rows get equal results. Null ``doc_id``
rows get a fingerprint, count for no component's smallest id, and have the component of their fingerprint (null if it
has no id at all). An empty table gives no rows. Extra columns are ignored by ``near_duplicates`` and kept by
``deduplicate``. Texts are hashed whole; memory follows the longest text.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import bytes_of, join_hot, map_batches, map_sorted_groups, mix64, rolling, struct, table, word_hashes, written
from .circulant import compared, shingle_set, texts_of
from .components import connected_components

SHINGLE, SEED, RADIUS, CHUNK, HOT = 3, 42, 3, 4096, 1000
BLOCKS = (11, 11, 11, 11, 10, 10)
WIDE_SHINGLE, WIDE_RADIUS, KEY_BITS, KEY_ROUNDS = 5, 50, 16, 3
WIDE = ("f0", "f1", "f2", "f3")
CONTRACTIONS, BROADCAST_IDS = 2, 100_000
_PAIRS_AT_ONCE, _WORDS_AT_ONCE = 1 << 15, 1 << 12
_LEADERS, _LEAD_FROM = 8, 256


def shingle_hashes(raw: bytes, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    text, k = b" ".join(words), min(k, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    first, end = start[: len(words) - k + 1].tolist(), (start + length)[k - 1 :].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, map(slice, first, end)), repeat(seed)), np.uint64, len(first))


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def fn(batch: pa.RecordBatch) -> dict:
        fp = np.array([fingerprint(shingle_hashes(t, k)) for t in bytes_of(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "fp": fp.view(np.int64)}

    return map_batches(docs.select("doc_id", "text"), fn, struct(doc_id="long", fp="long"))


def wide_fingerprint(raw: bytes, k: int = WIDE_SHINGLE) -> np.ndarray:
    """Four words of 64 bits: a bit is 1 if set in over half of the distinct shingles' hashes; no words: zeros."""
    ids = word_hashes(raw)
    shingles = np.unique(rolling(ids, min(k, len(ids)))) if len(ids) else ids
    counts = np.zeros(64 * len(WIDE), np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[i : i + (1 << 14)]
        hashes = np.stack([mix64(part + np.uint64(j)) for j in range(len(WIDE))], axis=1)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")


def wide_fingerprints(docs: DataFrame, k: int = WIDE_SHINGLE) -> DataFrame:
    """doc_id, f0 to f3 (the 256 bits as signed longs)."""

    def fn(batch: pa.RecordBatch) -> dict:
        fp = np.array([wide_fingerprint(t, k) for t in bytes_of(batch)], np.uint64).reshape(-1, len(WIDE)).view(np.int64)
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), **{c: np.ascontiguousarray(fp[:, i]) for i, c in enumerate(WIDE)}}

    return map_batches(docs.select("doc_id", "text"), fn, struct(doc_id="long", **dict.fromkeys(WIDE, "long")))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, bits): word j of a block holds bit j of its 64 lanes, padded with zeros. ``fps``: one or more words each."""
    fps = fps.reshape(len(fps), 1 if fps.ndim == 1 else fps.shape[1])
    lanes = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 64, 8 * fps.shape[1]), axis=2, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").view("<u8")[..., 0]


def within_radius(planes: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query fingerprint, block): (pair number, lane) of the lanes within the radius."""
    live, lanes = _words_within(planes, query, block, radius)
    pair, lane = _lanes_of(lanes)
    return live[pair], lane


def _lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def _words_within(planes: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with lanes within the radius, and these lanes as the bits of a word.

    The counters, 64 lanes to a word, start so that they run over (and stay so) just beyond the radius; pairs whose lanes
    all ran over are dropped.
    """
    query = query.reshape(len(query), 1 if query.ndim == 1 else query.shape[1])
    full, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    levels = max(1, radius.bit_length())
    spare = (1 << levels) - 1 - radius
    live = np.arange(len(query))
    count = [np.full(len(query), full if spare >> i & 1 else none) for i in range(levels)]
    over = np.zeros(len(query), np.uint64)
    for j in range(planes.shape[1]):
        carry = planes[block[live], j] ^ np.where(query[live, j // 64] >> np.uint64(j % 64) & np.uint64(1), full, none)
        for i in range(levels):
            count[i], carry = count[i] ^ carry, count[i] & carry
        over |= carry
        if j % 4 == 3 and j >= radius:
            stay = over != full
            if not stay.all():
                live, over, count = live[stay], over[stay], [c[stay] for c in count]
                if not len(live):
                    break
    return live, ~over


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union-find on arrays: the components' smallest indexes after linking i and j."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _pairs(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, skip=None):
    """Yields (i, j) of links between the queries and the lanes of their blocks ``first`` to ``last``."""
    todo = np.append(0, np.cumsum(last - first + 1))
    for lo in range(0, int(todo[-1]), _PAIRS_AT_ONCE):
        p = np.arange(lo, min(lo + _PAIRS_AT_ONCE, int(todo[-1])))
        at = np.searchsorted(todo, p, "right") - 1
        q, block = query[at], first[at] + p - todo[at]
        if skip:
            open_ = ~skip(q, block)
            q, block = q[open_], block[open_]
        live, words = _words_within(planes, fps[q], block, radius)
        for a in range(0, len(live), _WORDS_AT_ONCE):  # among near copies all lanes of all words are links
            pair, lane = _lanes_of(words[a : a + _WORDS_AT_ONCE])
            pair = live[a : a + _WORDS_AT_ONCE][pair]
            i, j = q[pair], block[pair] * 64 + lane
            real = (j != i) & (j < len(fps))
            yield i[real], j[real]


def forest(fps: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first that it is connected with, inside its group (links with neighbours of other groups
    may count too: a link is one wherever it is found)."""
    n, sizes = len(fps), np.diff(starts)
    if not n:
        return np.arange(0)
    labels, group = np.arange(n), np.repeat(np.arange(len(sizes)), sizes)
    first, last = starts[:-1] // 64, (starts[1:] - 1) // 64
    big = sizes[group] >= _LEAD_FROM
    order = np.arange(n)
    if big.any():
        planes, led = bit_planes(fps), np.zeros(n, bool)
        for _ in range(_LEADERS):
            alone = np.flatnonzero(big & ~led & (labels == np.arange(n)))
            _, at = np.unique(group[alone], return_index=True)
            leaders = alone[at]
            if not len(leaders):
                break
            led[leaders] = True
            for i, j in _pairs(planes, fps, leaders, first[group[leaders]], last[group[leaders]], radius):
                labels = _merge(labels, i, j)
        order = np.lexsort((labels, group))
    fps, labels = fps[order], labels[order]
    _, at, of = np.unique(labels, return_index=True, return_inverse=True)
    labels = at[of]  # now the first place of each component in the new order
    planes = bit_planes(fps)

    def same(q: np.ndarray, block: np.ndarray) -> np.ndarray:
        lanes = np.append(labels, np.full(-n % 64, labels[-1])).reshape(-1, 64)
        low, high = lanes.min(axis=1), lanes.max(axis=1)
        return (low[block] == high[block]) & (low[block] == labels[q])

    for i, j in _pairs(planes, fps, np.arange(n), np.arange(n) // 64, last[group], radius, same if big.any() else None):
        labels = _merge(labels, i, j)
    out = np.empty(n, np.int64)
    out[order] = order[labels]
    return out


def linked(cols: dict, starts: np.ndarray, radius: int = RADIUS) -> dict:
    """Spanning forests of the links inside groups of fingerprints ``fp``."""
    fps = cols["fp"].astype(np.int64)
    labels = forest(fps.view(np.uint64)[:, None], starts, radius)
    moved = np.flatnonzero(labels != np.arange(len(fps)))
    return {"a": fps[moved], "b": fps[labels[moved]]}


def _masks() -> list[int]:
    at = np.cumsum((0, *BLOCKS))
    blocks = [((1 << w) - 1) << int(a) for w, a in zip(BLOCKS, at)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, len(BLOCKS) - RADIUS))]


def near_links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the fingerprints ``fp``, enough to connect what is connected."""
    keys = distinct.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks())])).alias("key"))
    met = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return map_sorted_groups(_dealt(keys.join(met.hint("merge"), "key"), ["fp"], chunk), ["key", "lo", "hi"], linked, struct(a="long", b="long"))


def _dealt(rows: DataFrame, columns: list[str], chunk: int) -> DataFrame:
    """Rows (columns, key, n rows of the key), each once for every pair (lo, hi) of chunks that its own chunk is in."""
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / chunk))
    mine = F.pmod(F.xxhash64(*columns, "key"), F.col("chunks"))
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    rows = rows.select(*columns, "key", mine.alias("mine"), F.explode(other).alias("other"))
    return rows.select(*columns, "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))


def wide_keys(distinct: DataFrame, key_bits: int = KEY_BITS, rounds: int = KEY_ROUNDS) -> DataFrame:
    """(id, f0 to f3) -> the same with a ``key``, a row for each key: every round deals out the 256 bits anew."""
    bits = 64 * len(WIDE)
    deals = [np.random.default_rng(r).permutation(bits)[: bits // key_bits * key_bits] for r in range(rounds)]
    order = np.concatenate(deals).reshape(-1, key_bits)

    def fn(batch: pa.RecordBatch) -> dict:
        fps = np.stack([batch.column(c).to_numpy() for c in WIDE], axis=1)
        on = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
        key = np.repeat(np.arange(len(order))[None], len(fps), axis=0)
        for j in range(key_bits):
            key = key << 1 | on[:, order[:, j]]
        return {"key": key.ravel(), **{c: np.repeat(batch.column(c).to_numpy(), len(order)) for c in ("id", *WIDE)}}

    return map_batches(distinct.select("id", *WIDE), fn, struct(key="long", id="long", **dict.fromkeys(WIDE, "long")))


def wide_links(distinct: DataFrame, radius: int = WIDE_RADIUS, key_bits: int = KEY_BITS, rounds: int = KEY_ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (id, f0 to f3), enough to connect what the keys bring together."""

    def fn(cols: dict, starts: np.ndarray) -> dict:
        labels = forest(np.stack([cols[c] for c in WIDE], axis=1).astype(np.int64).view(np.uint64), starts, radius)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return {"a": cols["id"][moved], "b": cols["id"][labels[moved]]}

    keys = wide_keys(distinct, key_bits, rounds)
    met = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    # keys of a thousandth of the fingerprints or more are at most a thousand to each of a fingerprint's keys: they are broadcast
    hot = F.col("n") * HOT >= distinct.count()
    hot_keys, cold_keys = F.broadcast(met.filter(hot)), met.filter(~hot)
    # Spark takes ``keys`` for as many rows as there are fingerprints and would broadcast all of them below 10 MB
    rows = keys.join(hot_keys.select("key"), "key", "left_anti").join(cold_keys.hint("merge"), "key").unionByName(keys.join(hot_keys, "key"))
    links = map_sorted_groups(_dealt(rows, ["id", *WIDE], chunk), ["key", "lo", "hi"], fn, struct(a="long", b="long"), order=["id"])
    for _ in range(CONTRACTIONS):
        links = contracted(links)
    return links


def contracted(links: DataFrame) -> DataFrame:
    """The same components from fewer links (a, b): what an ``a`` is linked with is hung on the smallest of it. An ``a``
    has a link a key and chunk at most, so no group is large."""
    least = F.least("a", F.min("b").over(W.partitionBy("a")))
    hung = links.distinct().select("a", "b", least.alias("to"))
    return hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("to").alias("b")).filter("a <> b").distinct()


def similar_documents(docs: DataFrame, shingle: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS, key_bits: int = KEY_BITS, rounds: int = KEY_ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links): a row per row of ``docs`` that has a doc_id. Null
    and empty texts are alike; repeated rows get equal results; an empty table gives no rows; extra columns are ignored."""
    fps = written(wide_fingerprints(docs.filter("doc_id is not null"), shingle), "fingerprints")
    low = written(fps.groupBy(*WIDE).agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "distinct")
    labels = connected_components(wide_links(low, radius, key_bits, rounds, chunk))
    named = written(low.join(labels.withColumnRenamed("v", "id"), "id", "left").select(*WIDE, "n", F.coalesce("l", "id").alias("component_id")), "named")
    return _of_rows(fps, named, list(WIDE)).select("doc_id", "component_id")


def verified_documents(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """As ``similar_documents``, by those links only whose texts' shingle sets have a Jaccard similarity of 0.8 or more."""
    proposed = written(similar_documents(docs, shingle).distinct(), "proposed")
    sizes = proposed.groupBy("component_id").agg(F.count("*").alias("members")).filter("members > 1")
    ids = written(join_hot(proposed, written(sizes, "groups"), ["component_id"], "members").select(F.col("doc_id").alias("id"), F.col("component_id").alias("key")), "members")

    def fn(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(raw, shingle) for raw in bytes_of(batch)]
        c = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets], np.int64).reshape(-1, 2)
        return {"id": batch.column("id"), "n": [len(s) for s in sets], "c1": np.ascontiguousarray(c[:, 0]), "c2": np.ascontiguousarray(c[:, 1])}

    texts = written(texts_of(docs, ids), "member-texts")
    hashed = written(map_batches(texts, fn, struct(id="long", n="long", c1="long", c2="long")).join(ids, "id"), "hashed")
    # of equal sets in a group only the smallest id is compared; the others are its copies
    first = hashed.groupBy("key", "c1", "c2").agg(F.min("id").alias("first"), F.max("n").alias("n"), F.count("*").alias("copies"))
    first = written(first, "firsts")
    links = written(compared(first.select("key", F.col("first").alias("id"), "n", F.col("first").alias("label")).distinct(), texts, shingle), "verified")
    copies = join_hot(hashed.select("id", "key", "c1", "c2"), first.drop("n"), ["key", "c1", "c2"], "copies").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    labels = connected_components(links.unionByName(copies)).withColumnsRenamed({"v": "doc_id", "l": "found"})
    return proposed.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("found", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    fps = written(fingerprints(docs), "fingerprints")
    low = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    labels = connected_components(near_links(low.select("fp"), chunk))
    named = labels.withColumnRenamed("v", "fp").join(low, "fp")
    ids = named.groupBy("l").agg(F.min("low").alias("component_id"))
    of_fp = low.join(labels.withColumnRenamed("v", "fp").join(ids, "l").select("fp", "component_id"), "fp", "left").select("fp", "n", F.coalesce("component_id", "low").alias("component_id"))
    of_fp = written(of_fp, "named")
    return _of_rows(fps, of_fp, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _of_rows(fps: DataFrame, named: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with what is known of their fingerprint (columns, n rows, ...). Fingerprints of a thousandth of the rows or
    more are a thousand at most: they are broadcast, the rest is shuffled."""
    hot = F.col("n") * HOT >= (named.agg(F.sum("n")).first()[0] or 0)
    hot_ids, cold_ids = F.broadcast(named.filter(hot).drop("n")), named.filter(~hot).drop("n")
    cold = fps.join(hot_ids.select(*columns), columns, "left_anti").join(cold_ids, columns)
    return fps.join(hot_ids, columns).unionByName(cold)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of ``verified_documents``, that of the smallest ``doc_id``. Rows of one ``doc_id`` are one
    document (that of the smallest text stays); rows without one cannot be named and stay as they are."""
    groups = written(verified_documents(docs).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")), "groups")
    keep = groups.filter("doc_id = component_id")
    once = docs.join(keep.filter("n = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")  # one plan at every size
    several = keep.filter("n > 1").select("doc_id")
    repeated = docs.join(F.broadcast(several) if several.count() <= BROADCAST_IDS else several.hint("merge"), "doc_id", "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = repeated.groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("r"))
    one = one.select("doc_id", *[F.col("r")[c].alias(c) for c in ("text", *others)])
    return once.select(*docs.columns).unionByName(one.select(*docs.columns)).unionByName(docs.filter("doc_id is null"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
