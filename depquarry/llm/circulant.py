"""MinHash near duplicates with circulant signatures, candidates verified by their exact Jaccard similarity.

A document's set holds the distinct 2-word shingles of its text (A-Z lower-cased; with fewer words the whole sequence).
Circulant MinHash needs two permutations only: the first scatters a set's elements over ``UNIVERSE`` places, the second is
a table that coordinate k reads with a circular shift of k places. So an element's ``COORDINATES`` values are one slice
of the table, and a signature is the minimum of such slices. ``ROWS`` coordinates make a band; documents that agree in a
band are candidates. A pair at similarity 0.8 agrees in one of the 42 bands but for 3 in a million times.

Links are decided on whole sets: 100 * intersection >= 80 * union. Documents of equal sets are one class. Candidates are
compared in two steps, so that no step emits pairs: first every class with the smallest class that any of its bands leads
to, all classes of such a leader among each other; most bands then hold one component only. What is left, bands with
classes of several components that have not all been compared, is compared band by band. A comparison group is dealt
out in pairs of chunks when it is large; in a task a class is compared only with those of other components so far, and
what is found is reported as a spanning forest.

``component_id`` is the smallest doc_id that links reach, ``kept`` says that it is the document's own. Null and empty
texts have empty sets, linked with nothing. Repeated rows get equal results; rows of one doc_id with different texts are
one document for links. Rows without a doc_id have the component of their class (none if the class has no id; such rows
are kept). An empty table gives no rows. Extra columns are ignored, whatever their names. Texts are taken whole.
Shingles are told apart by 64-bit hashes, sets by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bytes_of, join_hot, map_batches, map_sorted_groups, mix64, rolling, sieve, struct, table, word_hashes, written
from .components import connected_components

SHINGLE, SIMILARITY = 2, 80
UNIVERSE_BITS, COORDINATES, ROWS = 20, 252, 6
#: Classes and shingles of a chunk; a comparison group holds two chunks at most.
CHUNK, CHUNK_SHINGLES = 512, 1 << 21
_TABLE: list[np.ndarray] = []


def shingle_set(raw: bytes, k: int = SHINGLE) -> np.ndarray:
    ids = word_hashes(raw)
    return np.unique(rolling(ids, min(k, len(ids)))) if len(ids) else ids


def _slices() -> np.ndarray:
    """Row i: the second permutation's values at the places i, i + 1, ... around the circle."""
    if not _TABLE:
        second = np.random.default_rng(12).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _TABLE.append(np.lib.stride_tricks.sliding_window_view(np.append(second, second[: COORDINATES - 1]), COORDINATES))
    return _TABLE[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The set's minima under all shifts; the first permutation is a bijective scrambling cut to its high bits."""
    places = np.unique((mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64))
    slices, out = _slices(), np.full(COORDINATES, 1 << UNIVERSE_BITS, np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(out, np.minimum.reduce(slices[places[i : i + 2048]], axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
    for j in range(ROWS):
        keys = mix64(keys ^ mix64(bands[:, :, j] + np.uint64(j << 32)))
    return keys.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), c1, c2 (the set's hash), keys (of its bands; none for an empty set)."""

    def fn(batch: pa.RecordBatch) -> dict:
        n, hashes, keys = [], [], []
        for raw in bytes_of(batch):
            s = shingle_set(raw)
            n.append(len(s))
            hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
            keys.append(band_keys(signature(s)[None])[0] if len(s) else None)
        c = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "n": n, "c1": np.ascontiguousarray(c[:, 0]), "c2": np.ascontiguousarray(c[:, 1]), "keys": keys}

    schema = T.StructType([*struct(doc_id="long", n="long", c1="long", c2="long").fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    return map_batches(docs.select("doc_id", "text"), fn, schema)


def links_among(cols: dict, starts: np.ndarray, k: int = SHINGLE) -> dict:
    """Groups of classes (id, label, mine, lo, hi, text): a spanning forest (a, b) of labels that links between classes of
    different labels connect. In a group of two chunks only classes of different chunks are compared."""
    a, b = [], []
    for lo, hi in zip(starts, starts[1:]):
        ids, of, mine = cols["id"][lo:hi], cols["label"][lo:hi], cols["mine"][lo:hi]
        if hi - lo < 2 or (of == of[0]).all():
            continue
        sets = [shingle_set((t or "").encode(), k) for t in cols["text"][lo:hi]]
        size, two = np.array([len(s) for s in sets]), cols["lo"][lo] != cols["hi"][lo]
        names, label = np.unique(of, return_inverse=True)
        at = np.append(0, np.cumsum(size))
        flat = np.concatenate(sets)
        for i in range(len(ids) - 1):
            open_ = (label != label[i]) & (100 * np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i]))
            open_[: i + 1] = False
            if two:
                open_ &= mine != mine[i]
            j = np.flatnonzero(open_)
            if not len(j):
                continue
            own, step = sets[i], size[j]
            ends = np.cumsum(step)
            theirs = flat[np.repeat(at[j] - (ends - step), step) + np.arange(ends[-1])]
            found = np.searchsorted(own, theirs)
            found[found == len(own)] = 0
            both = np.add.reduceat(own[found] == theirs, ends - step, dtype=np.int64)
            for other in np.unique(label[j[100 * both >= SIMILARITY * (size[i] + step - both)]]).tolist():
                a.append(names[label[i]])
                b.append(names[other])
                label[label == other] = label[i]
    return {"a": np.array(a, np.int64), "b": np.array(b, np.int64)}


def compared(groups: DataFrame, texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``groups`` (key, id, n, label) -> links (a, b) between labels, by sets of ``k``-word shingles. Large groups are dealt out as pairs of chunks."""
    size = groups.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    size = written(size.select("key", "rows", F.greatest(F.ceil(F.col("rows") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).alias("chunks")), "group-sizes")
    rows = join_hot(groups.select("key", "id", "label"), size, ["key"], "rows").select("key", "id", "label", "chunks", F.pmod(F.xxhash64("id", "key"), "chunks").alias("mine"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("key", "id", "label", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    met = written(rows.groupBy("id").agg(F.count("*").alias("times")), "met")
    texts = written(texts.join(met, "id"), "texts")
    linked = lambda cols, starts: links_among(cols, starts, k)
    return map_sorted_groups(join_hot(rows, texts, ["id"], "times"), ["key", "lo", "hi"], linked, struct(a="long", b="long"), order=["id"])


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents with those ids: ``docs`` passes a sieve first, so that few texts are shuffled."""
    wanted = written(ids.select("id").distinct(), "wanted")
    passes = sieve(wanted, wanted.count())
    kinds = struct(doc_id="long", text="string")

    def few(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").cast(pa.int64())
        batch = batch.filter(pa.array(passes.value.has(ids.to_numpy().view(np.uint64))))
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "text": batch.column("text").cast(pa.string())}

    some = map_batches(docs.filter("doc_id is not null").select("doc_id", "text"), few, kinds).withColumnRenamed("doc_id", "id")
    once = some.join(wanted, "id", "left_semi")
    return once.dropDuplicates(["id", "text"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    rows = written(signed(docs), "signed")
    classes = written(rows.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    bands = classes.filter("id is not null").select("id", "n", F.explode("keys").alias("key"))
    met = bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows")).filter("low < high")
    shared = written(join_hot(bands, written(met.drop("high"), "met"), ["key"], "rows"), "shared")  # key, id, n, low

    leader = written(shared.groupBy("id", "n").agg(F.min("low").alias("leader")), "leaders")
    led = leader.filter("id <> leader")
    first = led.select(F.col("leader").alias("key"), "id", "n", F.col("id").alias("label"))
    heads = leader.join(led.select(F.col("leader").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("key"), "id", "n", F.col("id").alias("label"))
    texts = written(texts_of(docs, leader), "shared-texts")
    links = written(compared(written(first.unionByName(heads), "led"), texts), "links")

    label = connected_components(links).withColumnsRenamed({"v": "id", "l": "label"})
    known = written(leader.join(label, "id", "left").select("id", "leader", F.coalesce("label", "id").alias("label")), "labels")
    there = written(shared.join(known, "id"), "labelled")
    under_low = F.sum(((F.col("id") != F.col("low")) & (F.col("leader") != F.col("low"))).cast("long")) == 0
    left = there.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), (under_low | (F.min("leader") == F.max("leader"))).alias("done"), F.count("*").alias("rows")).filter("l0 < l1 and not done")
    rest = written(join_hot(there.select("key", "id", "n", "label"), written(left.select("key", "rows"), "left"), ["key"], "rows"), "rest")
    more = written(compared(rest, texts), "links")

    joined = known.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more)
    component = connected_components(joined).withColumnsRenamed({"v": "id", "l": "component_id"})
    of_class = classes.drop("keys", "n").join(component, "id", "left").select("c1", "c2", "rows", F.coalesce("component_id", "id").alias("component_id"))
    named = written(of_class, "named")
    own = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    full = join_hot(rows.filter("n > 0").select("doc_id", "n", "c1", "c2"), named, ["c1", "c2"], "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", "n_shingles", "component_id", own.alias("kept"))


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * pair.n >= 80 * (x.n + y.n - pair.n)),
both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(low.b, d.doc_id) AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id"""
