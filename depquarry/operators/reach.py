"""What is reached in a graph, for all queries at once.

Traversals ask for many starts over one graph of archives, which is small beside the tables of symbols. A graph of
``EDGE_LIMIT`` edges or fewer, counted first, is numbered, packed and broadcast (four bytes an edge, eight a node). Tasks
then take 64 queries at a time, a bit each: a round moves all 64 along every edge of the frontier with bitwise ors, and
ends where nothing new is met. There is no shuffle a round, so depth costs little. A question about given nodes is
answered in the task, without a table of all that is reached. A larger graph first loses the edges to nodes that lead
nowhere, a layer at a time; these are joined on afterwards, once each. What is still too large goes the way of ``walk``,
round by round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import drop
from ..storage import settled as written

EDGE_LIMIT = 1 << 22
MAX_ROUNDS = 1000
_LANES = 64


def walk(pairs: DataFrame, starts: DataFrame, levels: int | None = None, with_path: bool = False) -> DataFrame:
    """Breadth first over ``pairs`` (item, dep) from ``starts`` (query_id, node): (query_id, node, level[, path]), a
    shuffle a round.

    A start has level 1; each (query, node) comes once, at its smallest level and, ``with_path``, with the smallest
    of its shortest paths. ``levels``: how deep to go; None or below 1 is all the way.
    """
    bound = levels if levels and levels > 0 else None
    pairs = written(pairs.select(F.col("item").alias("node"), F.col("dep").alias("next")).filter("next is not null").distinct(), "pairs")  # every round joins them; small ones are broadcast by size
    seen = starts.select("query_id", "node").distinct().withColumn("level", F.lit(1).cast("long"))
    if with_path:
        seen = seen.withColumn("path", F.array("node"))
    rounds = [written(seen, "walk")]
    while bound is None or len(rounds) < bound:
        if len(rounds) > MAX_ROUNDS:
            raise RuntimeError(f"not done after {MAX_ROUNDS} rounds")
        found = rounds[-1].join(pairs, "node").select("query_id", F.col("next").alias("node"), *(["path"] if with_path else []))
        if with_path:
            found = found.select("query_id", "node", F.concat("path", F.array("node")).alias("path")).groupBy("query_id", "node").agg(F.min("path").alias("path"))
        else:
            found = found.distinct()
        before = reduce(DataFrame.unionByName, [r.select("query_id", "node") for r in rounds])
        new = found.join(before, ["query_id", "node"], "left_anti").withColumn("level", F.lit(len(rounds) + 1).cast("long"))
        new = written(new.select(rounds[0].columns), "walk")
        if new.isEmpty():
            break
        rounds.append(new)
    return reduce(DataFrame.unionByName, rounds)


class Packed:
    """Edges by their source: ``nodes`` are the sorted ids, those of node i lead to ``to[at[i] : at[i + 1]]``. With ``n``
    the ids are the numbers below it."""

    def __init__(self, item: np.ndarray, dep: np.ndarray, n: int | None = None):
        if n is None:
            self.nodes, both = np.unique(np.concatenate([item, dep]), return_inverse=True)
            item, dep = both[: len(item)], both[len(item) :]
        else:
            self.nodes = np.arange(n, dtype=np.int32)
        order = np.argsort(item, kind="stable")
        self.to = dep[order].astype(np.int32)
        self.at = np.append(0, np.cumsum(np.bincount(item, minlength=len(self.nodes)))).astype(np.int64)

    def turned(self) -> Packed:
        """The same nodes, every edge the other way."""
        return Packed(self.to, np.repeat(self.nodes, np.diff(self.at)), len(self.nodes))

    def components(self) -> np.ndarray:
        """A number for each node, the same for those that hang together whichever way the edges go."""
        a, b = np.repeat(np.arange(len(self.nodes), dtype=np.int32), np.diff(self.at)), self.to
        label = np.arange(len(self.nodes), dtype=np.int32)
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label, label[label]):
                label = label[label]
        return label

    def step(self, front: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes one edge on, each with the bits that come to it."""
        size = self.at[front + 1] - self.at[front]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        to = self.to[np.repeat(self.at[front] - (ends - size), size) + np.arange(ends[-1])]
        order = np.argsort(to, kind="stable")
        to = to[order]
        new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        return to[new].astype(np.int64), np.bitwise_or.reduceat(np.repeat(bits, size)[order], new)

    def flood(self, lane: np.ndarray, place: np.ndarray, seen: np.ndarray, levels: int | None = None, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields a round's nodes and the bits new to them; ``seen`` is filled on the way. With ``own`` (each node's own
        bit) a lane goes no further once it is where it belongs."""
        front, of = np.unique(place, return_inverse=True)
        bits = np.zeros(len(front), np.uint64)
        np.bitwise_or.at(bits, of, np.uint64(1) << lane.astype(np.uint64))
        seen[front] |= bits
        level = 1
        while len(front):
            yield front, bits
            if own is not None:
                done = np.bitwise_or.reduce(bits & own[front])
                bits = bits & ~done
                front, bits = front[bits != 0], bits[bits != 0]
            if levels and level >= levels:
                return
            front, bits = self.step(front, bits)
            bits = bits & ~seen[front]
            front, bits = front[bits != 0], bits[bits != 0]
            seen[front] |= bits
            level += 1


def _bits_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, lane) of each bit that is set."""
    return np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def numbered(names: DataFrame, column: str, number: str) -> DataFrame:
    """The distinct values of a column, counted from 0 without a gap."""
    rows = written(names.select(column).distinct().withColumn("_at", F.monotonically_increasing_id()), "numbers")
    part = F.shiftright("_at", 33)
    before, begins = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        begins.append((r.part, before))
        before += r.n
    begins = names.sparkSession.createDataFrame(begins, "_part long, _begin long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_part", part).join(F.broadcast(begins), "_part").select(column, (within + F.col("_begin")).alias(number))


def _edges(pairs: DataFrame) -> DataFrame:
    return written(pairs.select("item", "dep").filter("item is not null and dep is not null").distinct(), "pairs")


def packed(pairs: DataFrame, limit: int | None = None):
    """A broadcast of the packed graph and (node, id) of its nodes; None if it has too many edges."""
    edges = _edges(pairs)
    if edges.count() <= (EDGE_LIMIT if limit is None else limit):
        return _pack(edges)
    drop(edges)
    return None


def _pack(edges: DataFrame):
    ids = numbered(edges.select(F.col("item").alias("node")).union(edges.select("dep")), "node", "id")
    ends = edges.join(ids.select(F.col("node").alias("item"), F.col("id").alias("a")), "item").join(ids.select(F.col("node").alias("dep"), F.col("id").alias("b")), "dep")
    ends = written(ends.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")), "ends")
    table = ends.toArrow()
    drop(edges, ends)
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    graph = Packed(a, b, int(max(a.max(), b.max())) + 1 if len(a) else 0)
    return ids.sparkSession.sparkContext.broadcast(graph), ids


def _by_query(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[dict]], schema: str | T.StructType, order: str = "q") -> DataFrame:
    """Rows (q, id, asked, ...) of whole queries, 64 at a time, to ``fn`` (lane, id, asked), which yields columns; a column
    ``lane`` comes back as ``q``. A column ``row`` alone says which of the rows given come back. Queries of one ``order``
    (which hangs on q) come one after another."""
    names = [c.split()[0] for c in schema.split(", ")] if isinstance(schema, str) else schema.names
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def answered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        q, id_, asked = (table.column(c).to_numpy() for c in ("q", "id", "asked"))
        new = np.append(True, q[1:] != q[:-1])
        queries, of = q[new], np.cumsum(new) - 1
        edges = np.append(np.flatnonzero(new), len(q))
        for lo in range(0, len(queries), _LANES):
            a, b = edges[lo], edges[min(lo + _LANES, len(queries))]
            for out in fn(of[a:b] - lo, id_[a:b], asked[a:b]):
                if "row" in out:
                    yield from table.take(pa.array(out["row"] + a)).select(names).combine_chunks().to_batches()
                    continue
                cols = [queries[out["lane"] + lo] if c == "q" else out[c] for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            q = batch.column("q").to_numpy()
            count += int((q[1:] != q[:-1]).sum()) + (q[0] != last)
            last = q[-1]
            if count > _LANES:  # all but the last query are whole
                table = pa.Table.from_batches(held)
                size = int(np.flatnonzero(table.column("q").to_numpy() != last)[-1]) + 1
                yield from answered(table.slice(0, size))
                held, count = table.slice(size).combine_chunks().to_batches(), 1
        if held:
            yield from answered(pa.Table.from_batches(held))

    key = ["q"] if order == "q" else [order, "q"]
    spread = rows.repartition(n, "q") if order == "q" else rows.repartitionByRange(n, *key)
    return spread.sortWithinPartitions(*key).mapInArrow(run, schema)


def meeting(graph, starts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (q, id, ...) whose node their query reaches from its ``starts`` (q, id), over a packed graph.
    They are shuffled once, as they are, and nothing is joined back."""
    rest = [f for f in wanted.schema if f.name not in ("q", "id")]
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", T.LongType()), *rest])
    begin = starts.select("q", "id", F.lit(False).alias("asked"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    rows = begin.unionByName(wanted.select("q", "id", F.lit(True).alias("asked"), *[f.name for f in rest]))

    def found(lane: np.ndarray, id_: np.ndarray, asked: np.ndarray) -> Iterator[dict]:
        g = graph.value
        busy = np.bincount(lane[asked], minlength=_LANES) > 0
        begin = ~asked & busy[lane]
        seen = np.zeros(len(g.nodes), np.uint64)
        for _ in g.flood(lane[begin], id_[begin], seen):
            pass
        hit = np.flatnonzero(asked)
        yield {"row": hit[seen[id_[hit]] >> lane[hit].astype(np.uint64) & np.uint64(1) == 1]}

    return _by_query(rows, found, schema)


def reach(pairs: DataFrame, starts: DataFrame, levels: int | None = None, limit: int | None = None) -> DataFrame:
    """As ``walk`` without paths: (query_id, node, level)."""
    starts = written(starts.select("query_id", "node").filter("node is not null").distinct(), "starts")
    limit = EDGE_LIMIT if limit is None else limit
    return _reach(_edges(pairs), starts, levels if levels and levels > 0 else None, limit)


def _reach(edges: DataFrame, starts: DataFrame, levels: int | None, limit: int) -> DataFrame:
    n = edges.count()
    if n > limit:
        items = edges.select(F.col("item").alias("dep")).distinct()
        inner = written(edges.join(items, "dep", "left_semi").select("item", "dep"), "pairs")
        if 2 * inner.count() > n:  # hardly any edge ends
            drop(inner)
            return walk(edges, starts, levels)
        last = written(edges.join(items, "dep", "left_anti").select(F.col("item").alias("node"), F.col("dep").alias("next")), "last-edges")
        drop(edges)
        before = written(_reach(inner, starts, levels, limit), "reached")
        found = before.filter(F.lit(True) if levels is None else F.col("level") < levels).join(last, "node")
        found = found.groupBy("query_id", F.col("next").alias("node")).agg((F.min("level") + 1).alias("level"))
        return before.unionByName(found.join(starts, ["query_id", "node"], "left_anti"))
    graph, ids = _pack(edges)
    queries = numbered(starts, "query_id", "q")
    asked = starts.join(ids, "node").join(queries, "query_id").select("q", "id", F.lit(False).alias("asked"))

    def found(lane: np.ndarray, id_: np.ndarray, _: np.ndarray) -> Iterator[dict]:
        g = graph.value
        seen = np.zeros(len(g.nodes), np.uint64)
        for level, (front, bits) in enumerate(g.flood(lane, id_, seen, levels)):
            word, to = _bits_of(bits)
            yield {"lane": to, "id": front[word], "level": np.full(len(to), level + 1, np.int64)}

    inside = _by_query(asked, found, "q long, id long, level long").join(ids, "id").join(queries, "q").select("query_id", "node", "level")
    apart = starts.join(ids.select("node"), "node", "left_anti").select("query_id", "node", F.lit(1).cast("long").alias("level"))
    return inside.unionByName(apart)


def reaching(pairs: DataFrame, starts: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of ``wanted`` (query_id, node, ...) whose node their query reaches from its ``starts`` (query_id, node)."""
    starts = written(starts.select("query_id", "node").filter("node is not null").distinct(), "starts")
    wanted = written(wanted, "wanted")
    found = packed(pairs, limit)
    key = ["query_id", "node"]
    if found is None:
        return wanted.join(walk(pairs, starts.join(wanted.select("query_id").distinct(), "query_id", "left_semi")).select(*key), key, "left_semi")
    graph, ids = found
    queries = numbered(wanted, "query_id", "q")
    named = lambda rows: rows.join(ids, "node").join(queries, "query_id").select("q", "id", *rows.columns)
    inside = meeting(graph, named(starts), named(wanted)).select(wanted.columns)
    apart = starts.join(ids.select("node"), "node", "left_anti")
    return inside.unionByName(wanted.join(apart, key, "left_semi"))


def round_trips(pairs: DataFrame, limit: int | None = None) -> DataFrame | None:
    """(node, hops): the shortest way of every node back to itself. None if the graph has too many edges. Nodes that hang
    together are asked for together, so 64 of them move along the edges of their part of the graph only."""
    found_ = packed(pairs, limit)
    if found_ is None:
        return None
    graph, ids = found_
    spark = pairs.sparkSession
    label = spark.sparkContext.broadcast(graph.value.components())

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_ = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(id_), pa.array(np.zeros(len(id_), bool)), pa.array(label.value[id_])], names=["q", "id", "asked", "part"])

    roots = ids.select("id").mapInArrow(labelled, "q long, id long, asked boolean, part int")

    def found(lane: np.ndarray, id_: np.ndarray, _: np.ndarray) -> Iterator[dict]:
        g = graph.value
        place = id_
        own, seen = np.zeros(len(g.nodes), np.uint64), np.zeros(len(g.nodes), np.uint64)
        own[place] = np.uint64(1) << lane.astype(np.uint64)
        size = g.at[place + 1] - g.at[place]
        first = np.concatenate([g.to[a:b] for a, b in zip(g.at[place], g.at[place + 1])]) if len(place) else np.empty(0, np.int64)
        for level, (front, bits) in enumerate(g.flood(np.repeat(lane, size), first.astype(np.int64), seen, own=own)):
            word, to = _bits_of(bits & own[front])
            yield {"lane": to, "hops": np.full(len(to), level + 1, np.int64)}

    return _by_query(roots, found, "q long, hops long", "part").join(ids.withColumnRenamed("id", "q"), "q").select("node", "hops")
