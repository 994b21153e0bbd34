"""From build records to the edge and node tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import detect_type
from ..schema import Graph
from ..storage import settled as written


def classify_child(children: DataFrame) -> DataFrame:
    """Adds ``type`` to tree rows (tree_id, pos, name, parent_pos, parent_type, child_ordinal): under an object the
    first child is its source and the rest headers, under an archive every child is an object, else the name tells."""
    kind = F.when(F.col("parent_type") == "object", F.when(F.col("child_ordinal") == 1, "source").otherwise("header")).when(F.col("parent_type") == "archive", "object").otherwise(detect_type(F.col("name")))
    return children.withColumn("type", kind)


def assemble_build_objects(nodes: DataFrame) -> DataFrame:
    """Tree rows (tree_id, pos, end_pos, name, type, parent_pos, parent_type) -> a build record per node, with the
    names of its children by field, in order."""
    under_object = F.col("parent_type") == "object"
    field = F.when(under_object & (F.col("type") == "source"), "source").when(under_object, "headers").when(F.col("type") == "object", "objects").otherwise("deps")
    node, child = F.struct("end_pos", F.col("name").alias("_id"), "type"), F.struct(F.col("pos").alias("at"), "name", field.alias("field"))
    # a node comes once for itself and once for its parent, so that one grouping makes the records
    row = lambda key, node, child: F.struct(F.col(key).alias("pos"), node.alias("node"), child.alias("child"))
    none = lambda c: F.when(F.lit(False), c)
    rows = nodes.select("tree_id", F.inline(F.array(row("pos", node, none(child)), row("parent_pos", none(node), child)))).filter("pos is not null")
    rolled = rows.groupBy("tree_id", "pos").agg(F.max("node").alias("node"), F.array_sort(F.collect_list("child")).alias("children"))
    names = lambda f: F.transform(F.filter("children", lambda x: x["field"] == f), lambda x: x["name"])
    some = lambda f: F.when(F.size(names(f)) > 0, names(f)).alias(f)
    return rolled.select("tree_id", "pos", "node.end_pos", "node._id", "node.type", F.get(names("source"), F.lit(0)).alias("source"), some("headers"), some("objects"), some("deps"), F.size("children").cast("long").alias("n_children"))


def dedupe_build_objects(records: DataFrame) -> DataFrame:
    """The record of each ``_id`` that was completed first: that with the smallest last line."""
    order = W.partitionBy("_id").orderBy("end_pos", F.desc("pos"), "tree_id")
    return records.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def attach_symbols(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbols`` (object_file, symbol, kind used/defined) onto objects that have a child."""
    lists = symbols.groupBy(F.col("object_file").alias("_id")).agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "used", F.col("symbol")))).alias("symdeps"), F.sort_array(F.collect_set(F.when(F.col("kind") == "defined", F.col("symbol")))).alias("symdefs"))
    has = (F.col("type") == "object") & (F.col("n_children") > 0)
    joined = records.join(lists, "_id", "left")
    return joined.withColumns({c: F.when(has, F.col(c)) for c in ("symdeps", "symdefs")})


def override_libdeps(records: DataFrame, libdeps: DataFrame) -> DataFrame:
    """Declared dependencies (line_no, _id, libdeps) replace parsed ones; the last line of an id wins."""
    last = libdeps.groupBy("_id").agg(F.max_by("libdeps", "line_no").alias("libdeps"))
    return records.join(last, "_id", "left").withColumn("deps", F.coalesce("libdeps", "deps")).drop("libdeps")


def filter_build_flavor(records: DataFrame, client_build: bool = False) -> DataFrame:
    return records.filter(F.col("_id").contains("client_build") == F.lit(client_build))


def edges_of(symdeps: DataFrame, symdefs: DataFrame, headers: DataFrame, source: DataFrame, deps: DataFrame, objects: DataFrame) -> DataFrame:
    """The eleven relationships from six pair sets (item, dep); inverses are swaps, distinct once per base set."""

    def both(pairs: DataFrame, there: str, back: str) -> list[DataFrame]:
        pairs = pairs.select("item", "dep").filter("item is not null and dep is not null").distinct()
        return [pairs.select(F.lit(there).alias("relationship"), "item", "dep"), pairs.select(F.lit(back).alias("relationship"), F.col("dep").alias("item"), F.col("item").alias("dep"))]

    parents = deps.select("item", "dep").union(objects.select("item", "dep")).filter("item is not null and dep is not null").distinct()
    parts = [
        *both(symdeps.filter("dep <> ''"), "file_to_symbol_dependencies", "symbol_to_file_dependencies"),
        *both(symdefs.filter("dep <> ''"), "file_to_symbol_definitions", "symbol_to_file_sources"),
        *both(headers.filter("dep <> ''"), "file_to_header_includes", "header_to_files_including"),
        *both(source, "file_to_source", "source_to_file"),
        both(deps, "target_to_dependencies", "")[0],
        both(objects, "archives_to_components", "")[0],
        parents.select(F.lit("dependency_to_targets").alias("relationship"), F.col("dep").alias("item"), F.col("item").alias("dep")),
    ]
    return reduce(DataFrame.unionAll, parts)


#: What a field of a build record becomes: its relationship and the inverse. Dependencies and components share theirs.
FIELDS = {
    "symdeps": ("file_to_symbol_dependencies", "symbol_to_file_dependencies"),
    "symdefs": ("file_to_symbol_definitions", "symbol_to_file_sources"),
    "headers": ("file_to_header_includes", "header_to_files_including"),
    "source": ("file_to_source", "source_to_file"),
    "deps": ("target_to_dependencies", "dependency_to_targets"),
    "objects": ("archives_to_components", "dependency_to_targets"),
}


def generate_edges(records: DataFrame, client_build: bool = False) -> DataFrame:
    """Build records of one flavor -> (relationship, item, dep). Object records feed symbols, headers and sources, all
    others dependencies and components.

    One pass: a record gives its pairs by inverse relationship, equal ones become one row that knows its fields, and only
    then both directions are made, so half of the edges are shuffled, once.
    """
    records = filter_build_flavor(records, client_build)
    have = dict(records.dtypes)

    def pairs(field: str):
        named = lambda x: F.struct(F.lit(FIELDS[field][1]).alias("back"), F.lit(field).alias("field"), x.alias("dep"))
        if field not in have:
            return F.array().cast("array<struct<back:string,field:string,dep:string>>")
        items = F.array(field) if field == "source" else F.coalesce(field, F.array().cast("array<string>"))
        empty = lambda x: x.isNull() | (x == "") if field in ("symdeps", "symdefs", "headers") else x.isNull()
        return F.transform(F.filter(items, lambda x: ~empty(x)), named)

    of_object, of_other = (F.concat(*map(pairs, fields)) for fields in (("symdeps", "symdefs", "headers", "source"), ("deps", "objects")))
    rows = records.filter("_id is not null and type is not null").select(F.col("_id").alias("item"), F.inline(F.when(F.col("type") == "object", of_object).otherwise(of_other)))
    once = rows.groupBy("back", "item", "dep").agg(*[F.max((F.col("field") == f)).alias(f) for f in FIELDS])
    edge = lambda relationship, item, dep: F.struct(relationship.alias("relationship"), F.col(item).alias("item"), F.col(dep).alias("dep"))
    there = [F.when(F.col(f), edge(F.lit(name), "item", "dep")) for f, (name, _) in FIELDS.items()]
    both = F.filter(F.array(*there, edge(F.col("back"), "dep", "item")), lambda x: x.isNotNull())
    return once.select(F.inline(both))


def collect_nodes(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Distinct (kind, name): symbols used or defined; files of every other place, and record ids (_id)."""
    symbol_ends = {"file_to_symbol_dependencies": (False, True), "file_to_symbol_definitions": (False, True)}
    base = edges.filter(F.col("relationship").isin("file_to_symbol_dependencies", "file_to_symbol_definitions", "file_to_header_includes", "file_to_source", "target_to_dependencies", "archives_to_components"))
    dep_kind = F.when(F.col("relationship").isin(*symbol_ends), "symbol").otherwise("file")
    nodes = base.select(F.lit("file").alias("kind"), F.col("item").alias("name")).union(base.select(dep_kind, "dep"))
    if ids is not None:
        nodes = nodes.union(ids.select(F.lit("file"), "_id"))
    return nodes.distinct()


def build_graph(records: DataFrame, client_build: bool = False, meta: DataFrame | None = None) -> Graph:
    records = written(records, "records")
    edges = written(generate_edges(records, client_build), "edges")  # each relationship is read by itself
    return Graph(edges, collect_nodes(edges, filter_build_flavor(records, client_build).select("_id")), meta)
