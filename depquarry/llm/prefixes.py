"""Conversation prefix trie: what conversations share with each other turn by turn, by smallest-member ownership.

Every distinct sequence of first turns (role, text) is a node; the conversations that begin so are its members. A node
belongs to its smallest member. Members get fewer on the way down, so a conversation owns an end piece of its path, told
by one number, the first depth it owns. Whatever is counted once a node of a subtree is then counted by owners: a
conversation adds to each node of its path the bytes of its own lower turns, less those of nodes that it owns, and one
leaf if it owns a node without children. So one group-by over prefixes gives every subtree's sums; no node meets its
descendants.

A prefix is known by two 64-bit sums of hashes of its turns and their places. Places and sums are running sums over rows
sorted by range partitions: each partition adds up its own rows, and a number a partition, carried by the driver, joins
the partitions together, so a conversation of any length is spread over tasks. Parents, ends and long conversations that
many rows meet are broadcast, a thousand keys at most. The hash over the ids that end at a node reads them in order:
sorted ranges put thousands of ids into one row first, and a node's rows are then hashed one by one in bounded memory.

``rebuilt`` splices conversations before: of conversation c the first h = crc32(c) % 9 turns are those of c - c % 5.

Turns are ordered by ``turn``, null first; turns of the same number by a hash of role and text. Null role or text counts
as empty. Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns each. An empty table
gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_type, join_hot, map_batches, runs_of, struct, table, written

SPLICE, TURNS = 5, 9
_KEY = ["k1", "k2", "depth"]


def running(df: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` (longs only) with c_run and c_before for every c of ``sums``: its sum over the rows of the same ``key`` up to
    and with this row, and before it. Sums wrap around at 64 bits."""
    n, columns = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns
    schema = T.StructType([*df.schema.fields, *struct(**{f"{c}_run": "long" for c in sums}).fields, *struct(part="int", i="long").fields])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, i, before, carry = TaskContext.get().partitionId(), 0, None, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            at = runs_of([keys])
            size, out = np.diff(at), {c: batch.column(c) for c in batch.schema.names}
            for c in sums:
                x = batch.column(c).to_numpy().astype(np.int64)
                total = np.cumsum(x)
                start = total[at[:-1]] - x[at[:-1]]
                if keys[0] == before:
                    start[0] -= carry[c]
                run = total - np.repeat(start, size)
                out[f"{c}_run"], carry[c] = run, run[-1]
            before = keys[-1]
            out |= {"part": np.full(len(keys), part, np.int32), "i": np.arange(i, i + len(keys))}
            i += len(keys)
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], arrow_type(f.dataType)) for f in schema], names=schema.names)

    rows = written(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).mapInArrow(local, schema), "running")
    ends = rows.groupBy("part").agg(F.min_by(key, "i").alias("first"), F.max_by(F.struct(key, *[f"{c}_run" for c in sums]), "i").alias("last")).orderBy("part").collect()  # a row a partition
    carried: dict[int, tuple] = {}
    last = None
    with np.errstate(over="ignore"):
        for e in ends:
            add = np.zeros(len(sums), np.int64)
            if last and last[0] == e.first:
                carried[e.part] = (e.first, add := last[1])
            last = (e.last[0], np.array(e.last[1:], np.int64) + (add if e.last[0] == e.first else 0))

    def whole(batch: pa.RecordBatch) -> dict:
        out = {c: batch.column(c) for c in columns}
        keys, part = batch.column(key).to_numpy(), batch.column("part").to_numpy()
        for j, c in enumerate(sums):
            run = batch.column(f"{c}_run").to_numpy().copy()
            for p in np.unique(part).tolist():
                if p in carried:
                    run[(part == p) & (keys == carried[p][0])] += carried[p][1][j]
            out |= {f"{c}_run": run, f"{c}_before": run - batch.column(c).to_numpy()}
        return out

    return map_batches(rows, whole, T.StructType([*df.schema.fields, *[f for c in sums for f in struct(**{f"{c}_run": "long", f"{c}_before": "long"}).fields]]))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (hashes of role and text), size (bytes of the text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), text("role").alias("role"), text("text").alias("text"))
    one = F.lit(1).cast("long").alias("one")
    hashed = written(rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("size"), one), "turns")
    return running(hashed, "conv_id", ["turn", "t1", "t2"], ["one"]).select("conv_id", F.col("one_run").alias("pos"), "t1", "t2", "size")


def rebuilt(turns: DataFrame, splice: int = SPLICE, turns_mod: int = TURNS) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id) and their turns (conv_id, depth from 1, t1, t2, size) after splicing."""
    turns = written(turns, "placed")
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", (F.crc32(c.cast("string")) % turns_mod).alias("h"), (c - c % splice).alias("base"))
    convs = written(convs, "conversations")
    heads = turns.filter(F.col("pos") < turns_mod).select(c.alias("base"), F.col("pos").alias("depth"), "t1", "t2", "size")
    spliced = written(convs.join(heads, "base").filter("depth <= h").select("conv_id", "depth", "t1", "t2", "size"), "spliced")
    taken = spliced.groupBy("conv_id").agg(F.count("*").alias("taken"))
    known = written(convs.join(taken, "conv_id", "left").select("conv_id", "n", "h", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")), "known")
    own = join_hot(turns, known, ["conv_id"], "n").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "t1", "t2", "size")
    return convs.select("conv_id"), spliced.unionByName(own)


def hash_of_ids(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, conv_id) -> (k1, k2, depth, ends_sha256): SHA-256 of the ascending ids, comma-joined."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict.fromkeys(_KEY, "long")

    def pieces(batch: pa.RecordBatch) -> dict:
        keys = [batch.column(c).to_numpy() for c in _KEY]
        at = runs_of(keys)
        ids = batch.column("conv_id").to_numpy()
        return {**{c: k[at[:-1]] for c, k in zip(_KEY, keys)}, "first": ids[at[:-1]], "ids": [",".join(map(str, ids[a:b].tolist())) for a, b in zip(at, at[1:])]}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")]):
                if key == open_:
                    digest.update(b",")
                else:
                    if digest:
                        out.append((*open_, digest.hexdigest()))
                    open_, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*_KEY, "ends_sha256"])
                out = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*open_, digest.hexdigest())], names=[*_KEY, "ends_sha256"])

    sorted_ = ends.select(*_KEY, "conv_id").repartitionByRange(n, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    texts = map_batches(sorted_, pieces, struct(**kinds, first="long", ids="string"))
    return texts.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashed, struct(**kinds, ends_sha256="string"))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Conversations (conv_id) and their turns (conv_id, depth, t1, t2, size) -> a row a node: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    zero = F.lit(0).cast("long")
    mixed = turns.select("conv_id", "depth", "size", F.xxhash64("depth", "t1", "t2").alias("m1"), F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("m2"))
    paths = running(mixed, "conv_id", ["depth"], ["m1", "m2", "size"])
    paths = paths.select("conv_id", "depth", F.col("m1_run").alias("k1"), F.col("m2_run").alias("k2"), F.col("m1_before").alias("p1"), F.col("m2_before").alias("p2"), F.col("size_before").alias("before"), "size")
    roots = convs.select("conv_id", *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "before", "size")])
    paths = written(paths.unionByName(roots), "paths")

    nodes = written(paths.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("p1", "p2", "before")]), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")

    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"), F.min("before").alias("above"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.max_by("k1", "depth").alias("k1"), F.max_by("k2", "depth").alias("k2"), F.sum("size").alias("bytes"))
    known = whole.join(owned, "conv_id", "left").select("conv_id", *_KEY, F.coalesce("first", F.col("depth") + 1).alias("first"), F.coalesce("above", "bytes").alias("above"), F.coalesce("leaf", zero).alias("leaf"))
    known = written(known, "known")

    counted = join_hot(paths.select(*_KEY, "conv_id", "before"), known.select("conv_id", "first", "above", "leaf", (F.col("depth") + 1).alias("rows")), ["conv_id"], "rows")
    saved = F.when(F.col("depth") < F.col("first"), F.col("above") - F.col("before")).otherwise(zero)
    sums = counted.groupBy(*_KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))

    upper = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    lower = nodes.filter("depth > 0").select(*_KEY, "conv_id", "n_convs", F.col("n_children").alias("children"), "p1", "p2", (F.col("depth") - 1).alias("above"))
    placed = join_hot(lower, upper, ["p1", "p2", "above"], "n_children").select(*_KEY, "conv_id", "parent_conv_id", "n_convs", F.col("children").alias("n_children"))
    placed = placed.unionByName(nodes.filter("depth = 0").select(*_KEY, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children"))

    out = placed.join(sums, _KEY).join(hash_of_ids(known), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


#: CRC-32 bit by bit: a byte comes in with its code, seven more steps with -1.
_CRC = "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: xor((CASE WHEN x >= 0 THEN xor(a, x) ELSE a END) >> 1, 3988292384::BIGINT * ((CASE WHEN x >= 0 THEN xor(a, x) ELSE a END) & 1)))"
OP13_SQL = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {{'role': coalesce(role, ''), 'text': coalesce("text", '')}} AS turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(turn ORDER BY pos) AS ts FROM t GROUP BY c),
k AS (SELECT c, c - c % 5 AS base, (xor({_CRC}, 4294967295::BIGINT) % 9)::INT AS h, ts FROM l),
r AS (SELECT k.c, list_concat(coalesce(b.ts[1:k.h], []), k.ts[k.h + 1:]) AS ts FROM k LEFT JOIN l b ON b.c = k.base),
occ AS (SELECT c, len(ts) AS n, d, ts[1:d] AS node, CASE WHEN d > 0 THEN octet_length(encode(ts[d].text)) ELSE 0 END AS bytes FROM r, LATERAL (SELECT unnest(range(len(ts) + 1)) AS d)),
node AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM occ GROUP BY node, d),
kids AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids USING (node)),
sub AS (SELECT node[1:a] AS node, sum(saved)::BIGINT AS saved_tokens, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves FROM full_, LATERAL (SELECT unnest(range(d + 1)) AS a) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.kids AS n_children, n_leaves, saved_tokens, v.ends AS ends_sha256
FROM full_ v JOIN sub USING (node) LEFT JOIN node p ON v.d > 0 AND p.d = v.d - 1 AND p.node = v.node[1:v.d - 1]"""
