"""Traversals of the graph. Rounds of joins are written to the shared folder, so lineage stays short and a lost executor
repeats one round; a round limit fails loudly instead of returning part of an answer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import Graph
from ..storage import settled as written
from .reach import MAX_ROUNDS, reach, round_trips, walk

def closure(graph: Graph, names: DataFrame, levels: int | None = None) -> DataFrame:
    """What (query_id, name) reaches over declared dependencies, with level; itself included, safe on cycles."""
    return reach(graph.rel("target_to_dependencies"), names.select("query_id", F.col("name").alias("node")), levels)


def parent_pairs(graph: Graph) -> DataFrame:
    """(item, dep): a build object and what includes it: containers, objects including a header, objects of a source."""
    return reduce(DataFrame.unionAll, [graph.rel(r) for r in ("dependency_to_targets", "header_to_files_including", "source_to_file")])


def parents_of(graph: Graph, names: DataFrame) -> DataFrame:
    """(query_id, name) -> (query_id, name, parent), a list: repeats stay."""
    return names.join(parent_pairs(graph).select(F.col("item").alias("name"), F.col("dep").alias("parent")), "name").select("query_id", "name", "parent")


# Executables by bucket; those of the last row are known but in no bucket.
EXECUTABLES = {
    "mongod": ["mongod"],
    "mongos": ["mongos"],
    "tools": ["mongotop", "mongodump", "mongoexport", "mongoimport", "mongobridge", "mongoperf", "bsondump", "mongofiles", "mongosniff", "mongorestore", "mongostat", "mongooplog"],
    "cppclientdriver": ["firstExample", "rsExample", "authTest", "httpClientTest", "tutorial", "clientTest", "whereExample", "secondExample"],
    None: ["test", "perftest"],
}


def default_executables(graph: Graph) -> DataFrame:
    """(name, bucket) of the known executables."""
    rows = [(n, b) for b, names in EXECUTABLES.items() for n in names]
    return graph.edges.sparkSession.createDataFrame(rows, "name string, bucket string")


def undotted_executables(graph: Graph) -> DataFrame:
    """Instead of a list: files without a dot in their name."""
    return graph.names("file").filter(~F.col("name").contains("."))


def executables(graph: Graph, names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query_id, name) -> (query_id, name, executable): the executables a file ends up in, itself included.

    One walk down from the (few) executables answers for all files at once.
    """
    known = default_executables(graph) if known is None else known
    down = parent_pairs(graph).select(F.col("dep").alias("item"), F.col("item").alias("dep"))
    below = reach(down, known.select(F.col("name").alias("query_id"), F.col("name").alias("node")))
    below = written(below.select(F.col("node").alias("name"), F.col("query_id").alias("executable")), "below")
    # each pair is there once, so only repeated names could repeat a row; dealt out by name they meet both
    return names.select("query_id", "name").repartition("name").distinct().join(below, "name").select("query_id", "name", "executable")


def exec_digest(found: DataFrame, buckets: DataFrame) -> DataFrame:
    """(…, executable) with ``buckets`` (name, bucket) -> (query_id, name, bucket); executables in no bucket vanish."""
    known = buckets.filter("bucket is not null").select(F.col("name").alias("executable"), "bucket")
    return found.join(known, "executable").select("query_id", "name", "bucket").distinct()


def with_neighbours(paths: DataFrame, *keys: str) -> DataFrame:
    """Sorted paths with ``shared``, how many names a path begins with like the one before it (of the same keys), and
    ``absorbed``, whether the next one begins with all of it.

    Rows are sorted over range partitions and compared with their neighbour only; what stands at the edges of partitions,
    a row or two each, is compared afterwards. So no path meets its prefixes, and one tree is spread over many tasks.
    """
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, "path"]
    rows = paths.select(*columns)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, t in (("shared", T.IntegerType()), ("absorbed", T.BooleanType()), ("part", T.IntegerType()), ("place", T.IntegerType())))])

    def common(a: tuple, b: tuple) -> int:
        if a[:-1] != b[:-1]:
            return 0
        return next((i for i, (x, y) in enumerate(zip(a[-1], b[-1])) if x != y), min(len(a[-1]), len(b[-1])))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows_ = list(zip(*[batch.column(c).to_pylist() for c in columns]))
            out = []
            for row in rows_:
                row = (*row[:-1], tuple(row[-1]))
                shared = common(before, row) if before else None
                if held:
                    out.append((*held, before[:-1] == row[:-1] and shared == len(before[-1])))
                held, before = (row, shared, 0 if shared is None else 1), row
            if out:
                yield made(out, part)
        if held:
            yield made([(held[0], held[1], held[2] + 2, None)], part)

    def made(out: list, part: int) -> pa.RecordBatch:
        row, shared, place, absorbed = zip(*out)
        arrays = [pa.array(list(x), to_arrow_type(f.dataType)) for x, f in zip(zip(*row), rows_fields)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(shared, pa.int32()), pa.array(absorbed, pa.bool_()), pa.array([part] * len(out), pa.int32()), pa.array(place, pa.int32())], names=schema.names)

    rows_fields = rows.schema.fields
    done = written(rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns).mapInArrow(compared, schema), "neighbours")
    # place: 0 first of its partition, 1 amid, 2 first and last, 3 last
    edges = sorted((r.part, r.place != 0, (*r[: len(keys)], tuple(r.path))) for r in done.filter("place <> 1").select(*columns, "part", "place").collect())
    firsts = {p: row for p, _, row in reversed(edges)}
    lasts = {p: row for p, _, row in edges}
    fixes, parts = [], sorted(firsts)
    for p, q in zip([None, *parts], [*parts, None]):
        if p is None or q is None:
            continue
        shared = common(lasts[p], firsts[q])
        fixes.append((q, shared, None))
        fixes.append((p, None, lasts[p][:-1] == firsts[q][:-1] and shared == len(lasts[p][-1])))
    fix = paths.sparkSession.createDataFrame(fixes, "part int, s int, a boolean").groupBy("part").agg(F.max("s").alias("s"), F.max("a").alias("a"))
    fixed = done.join(F.broadcast(fix), "part", "left")  # two rows a partition
    return fixed.select(*columns, F.coalesce("shared", "s", F.lit(0)).alias("shared"), F.coalesce("absorbed", "a", F.lit(False)).alias("absorbed"))


def absorb(paths: DataFrame, *keys: str) -> DataFrame:
    """Drop repeats and paths that are a strict prefix of another of the same key, as merging them into a trie would."""
    return with_neighbours(paths, *keys).filter("not absorbed").select(*keys, "path")


def tree_flip(paths: DataFrame, *keys: str) -> DataFrame:
    return absorb(paths.select(*keys, F.reverse("path").alias("path")), *keys)


def paths_to_tree(paths: DataFrame, *keys: str) -> DataFrame:
    """The trie as its nodes: (…, depth, parent_path, name). A path gives the nodes that the path before it lacks."""
    new = with_neighbours(paths, *keys).filter("shared < size(path)")
    node = "transform(sequence(shared + 1, size(path)), n -> struct(n as depth, slice(path, 1, n - 1) as parent_path, path[n - 1] as name))"
    return new.select(*keys, F.inline(F.expr(node)))


def tree_paths(tree: DataFrame, *keys: str) -> DataFrame:
    """The paths of a trie of ``paths_to_tree`` back."""
    return absorb(tree.select(*keys, F.concat("parent_path", F.array("name")).alias("path")), *keys)


def _family(graph: Graph, starts: DataFrame, depth: int | None, order: str) -> DataFrame:
    """``starts`` (query_id, node) -> (query_id, path)."""
    if order not in ("outermost_first", "reference"):
        raise ValueError("order: outermost_first or reference")
    if not depth or depth < 1:
        return starts.select("query_id", F.array("node").alias("path")).limit(0)
    up = graph.rel("dependency_to_targets").select(F.col("item").alias("node"), F.col("dep").alias("parent")).distinct()
    starts = starts.select("query_id", "node").distinct()
    if order == "outermost_first":
        chains = starts.select("query_id", "node", F.array("node").alias("path"))
        for _ in range(depth - 1):
            chains = chains.join(up, "node", "left").select("query_id", F.coalesce("parent", F.lit(None)).alias("node"), F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat(F.array("parent"), "path")).alias("path"))
        return absorb(chains, "query_id")
    # every level turns its paths round: the paths above a node, deepest level first
    layers, layer = [], starts.select("node").distinct()
    for _ in range(depth - 1):
        layers.append(layer)
        layer = layer.join(up, "node").select(F.col("parent").alias("node")).distinct()
    above = None  # (node, path) of k levels
    for layer in reversed(layers):
        pairs = up.join(layer, "node", "left_semi")
        if above is None:
            above = pairs.select("node", F.array("parent").alias("path"))
        else:
            upper = above.select(F.col("node").alias("parent"), F.col("path").alias("rest"))
            above = absorb(pairs.join(upper, "parent", "left").select("node", F.concat(F.reverse(F.coalesce("rest", F.array().cast("array<string>"))), F.array("parent")).alias("path")), "node")
    if above is None:
        return starts.select("query_id", F.array("node").alias("path"))
    rest = F.coalesce("path", F.array().cast("array<string>"))
    return absorb(starts.join(above, "node", "left").select("query_id", F.concat(F.reverse(rest), F.array("node")).alias("path")), "query_id")


def file_family_paths(graph: Graph, names: DataFrame, depth: int | None, order: str = "outermost_first") -> DataFrame:
    """Containers of files to a depth: (query_id, name) -> (query_id, path). ``order='reference'`` turns each level round."""
    return _family(graph, names.select("query_id", F.col("name").alias("node")), depth, order)


def symbol_family_paths(graph: Graph, symbols: DataFrame, depth: int | None, order: str = "outermost_first") -> DataFrame:
    """As ``file_family_paths``, from the files that define the symbols (query_id, symbol)."""
    defined = graph.rel("symbol_to_file_sources").select(F.col("item").alias("symbol"), F.col("dep").alias("node"))
    return _family(graph, symbols.join(defined, "symbol").select("query_id", "node"), depth, order)


def libs_cycle(lib_edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(query_id, archive) -> (query_id, target, hops, path) for archives reachable from what the query's archives need."""
    pairs = lib_edges.select(F.col("src").alias("item"), F.col("dst").alias("dep"))
    starts = roots.join(pairs.withColumnRenamed("item", "archive"), "archive").select("query_id", F.col("dep").alias("node"))
    found = walk(pairs, starts, with_path=True)
    return roots.distinct().join(found.withColumnRenamed("node", "archive"), ["query_id", "archive"]).select("query_id", F.col("archive").alias("target"), F.col("level").alias("hops"), "path")


def lib_cycles_all(lib_edges: DataFrame) -> DataFrame:
    """(archive, cycle): archives on a cycle, a self edge included, and the smallest archive of their cycle's component.

    Strongly connected components by colouring: each round spreads the smallest name forward, then walks back from
    each name inside its colour; what meets is a component. Edges of settled archives go before the next round.
    """
    edges = written(lib_edges.select("src", "dst").distinct(), "cycle-edges")
    loops = edges.filter("src = dst").select(F.col("src").alias("archive"), F.col("src").alias("cycle"))
    parts, live = [loops], edges.filter("src <> dst")
    for _ in range(MAX_ROUNDS):
        # archives without a way in or out are on no cycle
        live = written(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cycle-edges")
        if live.isEmpty():
            break
        color = _least_reaching(live)
        inside = live.join(color.select(F.col("node").alias("src"), F.col("color").alias("c1")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c2")), "dst").filter("c1 = c2")
        back = walk(inside.select(F.col("dst").alias("item"), F.col("src").alias("dep")), color.filter("node = color").select(F.col("color").alias("query_id"), "node"))
        done = written(back.select(F.col("node").alias("archive"), F.col("query_id").alias("cycle")), "cycle-parts")
        sizes = done.groupBy("cycle").agg(F.count("*").alias("n")).filter("n > 1").select("cycle")
        parts.append(done.join(sizes, "cycle", "left_semi").select("archive", "cycle"))
        settled = done.select("archive")
        live = live.join(settled.withColumnRenamed("archive", "src"), "src", "left_anti").join(settled.withColumnRenamed("archive", "dst"), "dst", "left_anti").select("src", "dst")
    else:
        raise RuntimeError(f"cycles not settled after {MAX_ROUNDS} rounds")
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("archive").agg(F.min("cycle").alias("cycle"))


def shortest_cycles(lib_edges: DataFrame) -> DataFrame:
    """(archive, hops): the shortest way of every archive on a cycle back to itself.

    64 archives at a time, each until it meets itself. If there are too many edges for that, by walks inside components.
    """
    edges = written(lib_edges.select("src", "dst").distinct(), "cycle-edges")
    found = round_trips(edges.select(F.col("src").alias("item"), F.col("dst").alias("dep")))
    return walked_cycles(edges) if found is None else found.select(F.col("node").alias("archive"), "hops")


def walked_cycles(edges: DataFrame) -> DataFrame:
    on = written(lib_cycles_all(edges), "cycles")
    inside = edges.join(on.select(F.col("archive").alias("src"), F.col("cycle").alias("c1")), "src").join(on.select(F.col("archive").alias("dst"), F.col("cycle").alias("c2")), "dst").filter("c1 = c2").select("src", "dst")
    roots = on.select(F.col("archive").alias("query_id"), "archive")
    return libs_cycle(written(inside, "cycle-edges"), roots).select(F.col("target").alias("archive"), "hops")


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, color): the smallest node that reaches each node, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    color = nodes.select("node", F.col("node").alias("color"), F.lit(True).alias("moved"))
    for _ in range(MAX_ROUNDS):
        color = written(color, "color")
        moved = color.filter("moved")
        if moved.isEmpty():
            return color.select("node", "color")
        given = edges.join(moved.select(F.col("node").alias("src"), "color"), "src").groupBy("dst").agg(F.min("color").alias("given"))
        color = color.join(given.withColumnRenamed("dst", "node"), "node", "left").select("node", F.least("color", "given").alias("color"), (F.coalesce("given", "color") < F.col("color")).alias("moved"))
    raise RuntimeError(f"colours not settled after {MAX_ROUNDS} rounds")
