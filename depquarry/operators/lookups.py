"""Lookups and set operations on the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RELATIONSHIPS, Graph
from .names import expand_file_names, expand_symbol_names

#: The lookups by name: relationship, and whether the name is a symbol's.
LOOKUPS = {
    "sources": ("symbol_to_file_sources", True),
    "uses": ("symbol_to_file_dependencies", True),
    "definitions": ("file_to_symbol_definitions", False),
    "dependencies": ("file_to_symbol_dependencies", False),
    "children": ("target_to_dependencies", False),
    "parents": ("dependency_to_targets", False),
    "components": ("archives_to_components", False),
    "headers": ("file_to_header_includes", False),
    "objects-including": ("header_to_files_including", False),
    "source": ("file_to_source", False),
    "object-built": ("source_to_file", False),
}


def _sets(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_set("dep")).alias("deps"))


def graph_get(graph: Graph, relationship: str, names: DataFrame) -> DataFrame:
    """``names`` (name) -> (item, deps): exact adjacency, an empty array where there is no edge."""
    return _sets(names.select(F.col("name").alias("item")).distinct().join(graph.rel(relationship), "item", "left"), "item")


def lookup(graph: Graph, what: str, roots: DataFrame) -> DataFrame:
    """One of ``LOOKUPS``, names expanded first: (query_id, item, deps)."""
    relationship, symbol = LOOKUPS[what]
    full = expand_symbol_names(roots, graph.names("symbol")) if symbol else expand_file_names(roots, graph.names("file"))
    items = full.select("query_id", F.col("full_name").alias("item")).distinct()
    return _sets(items.join(graph.rel(relationship), "item", "left"), "query_id", "item")


def graph_get_startswith(graph: Graph, relationship: str, text: str) -> DataFrame:
    return _sets(graph.rel(relationship).filter(F.col("item").startswith(text)), "item")


def graph_get_endswith(graph: Graph, relationship: str, text: str) -> DataFrame:
    return _sets(graph.rel(relationship).filter(F.col("item").endswith(text)), "item")


def graph_get_contains(graph: Graph, relationship: str, text: str) -> DataFrame:
    return _sets(graph.rel(relationship).filter(F.col("item").contains(text)), "item")


def graph_holds(graph: Graph, relationship: str, dep: str) -> DataFrame:
    """Items whose set holds ``dep``, with the whole set."""
    pairs = graph.rel(relationship)
    return _sets(pairs.join(pairs.filter(F.col("dep") == dep).select("item").distinct(), "item", "left_semi"), "item")


def graph_nodes(graph: Graph, relationship: str) -> DataFrame:
    return graph.rel(relationship).select("item").distinct()


def graph_slice(graph: Graph, relationship: str) -> DataFrame:
    return graph.rel(relationship)


def graph_resolve(graph: Graph, item: str) -> DataFrame:
    """(relationship, deps) for each of the eleven relationships, empty where the item has no edges."""
    spark = graph.edges.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, RELATIONSHIPS))).alias("relationship"))
    return _sets(every.join(graph.edges.filter(F.col("item") == item).select("relationship", "dep"), "relationship", "left"), "relationship")


def graph_narrow(graph: Graph, items: DataFrame) -> DataFrame:
    """Edges of only the items (name)."""
    return graph.edges.join(items.select(F.col("name").alias("item")).distinct(), "item", "left_semi").select("relationship", "item", "dep")


def results_narrow(results: DataFrame, names: DataFrame) -> DataFrame:
    """Result edges (relationship, source, target, edge) whose source ends with one of the names; every match counts."""
    sources = results.select(F.col("source").alias("name")).distinct()
    roots = names.select(F.lit(0).alias("query_id"), F.lit(0).alias("input_ord"), "name").distinct()
    return results.join(expand_file_names(roots, sources).select(F.col("full_name").alias("source")).distinct(), "source", "left_semi").select(*results.columns)


def merge_graphs(graph: Graph, other: Graph) -> Graph:
    """Union of edges and nodes; ours is the meta table. Another graph's unknown relationship is an error."""
    unknown = other.edges.filter(~F.col("relationship").isin(*RELATIONSHIPS)).select("relationship").limit(1).collect()
    if unknown:
        raise ValueError(f"no such relationship: {unknown[0][0]}")
    return Graph(graph.edges.unionByName(other.edges).distinct(), graph.nodes.unionByName(other.nodes).distinct(), graph.meta)


def add_edges(graph: Graph, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> Graph:
    """With more edges and nodes; those of an unknown relationship or list are ignored."""
    e = graph.edges if edges is None else graph.edges.unionByName(edges.filter(F.col("relationship").isin(*RELATIONSHIPS))).distinct()
    n = graph.nodes if nodes is None else graph.nodes.unionByName(nodes.filter(F.col("kind").isin("symbol", "file"))).distinct()
    return Graph(e, n, graph.meta)


def source_to_object(graph: Graph, sources: DataFrame) -> DataFrame:
    """(query_id, name) -> (query_id, name, object); duplicates stay, several objects a source are allowed."""
    return sources.join(graph.rel("source_to_file").select(F.col("item").alias("name"), F.col("dep").alias("object")), "name").select("query_id", "name", "object")


def object_to_source(graph: Graph, objects: DataFrame) -> DataFrame:
    """(query_id, name) -> (query_id, name, source)."""
    return objects.join(graph.rel("file_to_source").select(F.col("item").alias("name"), F.col("dep").alias("source")), "name").select("query_id", "name", "source")


def attach_extra_info(spark: SparkSession, timestamp: int, path: str, extra_info: str, subset: bool = False) -> DataFrame:
    """The one-row meta table; ``extra_info`` is JSON such as ``{"version_info": {...}, "build_info": {...}}``."""
    return spark.createDataFrame([(timestamp, path, subset, 2, extra_info)], "timestamp long, path string, subset boolean, v int, extra_info string")


def version_and_build_info(meta: DataFrame) -> DataFrame:
    """Branch, hash, tag, flags and platform out of ``extra_info``."""
    info = F.from_json("extra_info", "version_info struct<branch:string,hash:string,tag:string>, build_info struct<flags:array<string>,platform:string>")
    return meta.select(info.alias("i")).select("i.version_info.*", "i.build_info.*")
