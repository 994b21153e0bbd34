"""Libraries needed, library edges, and declared dependencies that are not needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_client, is_object
from ..schema import Graph
from ..storage import drop
from ..storage import settled as written
from .symbols import SYMBOL_EDGES, symbol_info


def _definers(graph: Graph) -> DataFrame:
    """(symbol, n, only): one row a symbol, so that the join from needing rows is n:1."""
    pairs = graph.rel("symbol_to_file_sources").filter(~is_client(F.col("dep")))
    return pairs.groupBy(F.col("item").alias("symbol")).agg(F.count("*").alias("n"), F.min("dep").alias("only"))


def _needed(graph: Graph, names: DataFrame, exclude: DataFrame | None, among: DataFrame) -> DataFrame:
    """``symbol_info`` of the symbols (symbol) in ``among`` only; what others use is not carried along."""
    if exclude is not None:
        among = among.join(exclude.select("symbol").distinct(), "symbol", "left_anti")
    used = graph.rel(SYMBOL_EDGES["dependency"]).select(F.col("item").alias("object"), F.col("dep").alias("symbol"))
    used = written(used.join(among, "symbol", "left_semi"), "used")
    needed = written(symbol_info(graph, names, 1, "dependency", used), "needed")
    drop(used)
    return needed


def libs_needed_good(graph: Graph, names: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, input_ord, name) -> (query_id, archive): what holds the uniquely defined symbols in use. ``exclude``
    (symbol): symbols not to be looked for."""
    unique = written(_definers(graph).filter("n = 1").select("symbol", F.col("only").alias("object")), "unique")
    needed = _needed(graph, names, exclude, unique.select("symbol")).select("query_id", "symbol").distinct()
    holders = graph.rel("dependency_to_targets").select(F.col("item").alias("object"), F.col("dep").alias("archive"))
    return needed.join(unique, "symbol").select("query_id", "object").distinct().join(holders, "object").select("query_id", "archive").distinct()


def libs_needed_bad(graph: Graph, names: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, input_ord, archive, object, symbol, candidates): one row per needing row of an ambiguous symbol, with
    the sorted archives that could provide it (maybe none)."""
    many = written(_definers(graph).filter("n > 1").select("symbol"), "many")
    needed = _needed(graph, names, exclude, many)
    pairs = graph.rel("symbol_to_file_sources").filter(~is_client(F.col("dep"))).select(F.col("item").alias("symbol"), F.col("dep").alias("object")).join(many, "symbol", "left_semi")
    holders = graph.rel("dependency_to_targets").select(F.col("item").alias("object"), F.col("dep").alias("archive"))
    candidates = pairs.join(holders, "object", "left").groupBy("symbol").agg(F.sort_array(F.collect_set("archive")).alias("candidates"))
    return needed.join(candidates, "symbol").select("query_id", "input_ord", "archive", "object", "symbol", "candidates")


def all_archives(graph: Graph) -> DataFrame:
    """Every archive as its own query."""
    names = graph.rel("archives_to_components").select(F.col("item").alias("name")).distinct()
    return names.select(F.col("name").alias("query_id"), F.lit(0).alias("input_ord"), "name")


def lib_edges(graph: Graph) -> DataFrame:
    """(src, dst): ``libs_needed_good`` of all archives in one pass; self edges stay."""
    return libs_needed_good(graph, all_archives(graph)).select(F.col("query_id").alias("src"), F.col("archive").alias("dst"))


def extra_libdeps(graph: Graph, names: DataFrame) -> DataFrame:
    """(query_id, input_ord, name) -> (query_id, archive, extra), all or nothing: if the query's names define a symbol
    that an archive does not itself need, all the archive's declared dependencies are reported."""
    defined = symbol_info(graph, names, 1, "definition").select("query_id", "symbol").distinct()
    each = names.select(F.struct("query_id", "name").alias("query_id"), F.lit(0).alias("input_ord"), "name").distinct()
    needed = symbol_info(graph, each, 1).select("query_id.query_id", F.col("query_id.name").alias("archive"), "symbol").distinct()
    pairs = names.select("query_id", F.col("name").alias("archive")).distinct().join(defined, "query_id")
    reported = pairs.join(needed, ["query_id", "archive", "symbol"], "left_anti").select("query_id", "archive").distinct()
    deps = graph.rel("target_to_dependencies").select(F.col("item").alias("archive"), F.col("dep").alias("extra"))
    return reported.join(deps, "archive").select("query_id", "archive", "extra")


def all_extra_libdeps(graph: Graph) -> DataFrame:
    """The same for every archive as result edges; archives without extras are absent."""
    found = extra_libdeps(graph, all_archives(graph))
    return found.select(F.lit("unneeded_archives").alias("relationship"), F.col("archive").alias("source"), F.col("extra").alias("target"), F.lit(None).cast("string").alias("edge")).distinct()


def extra_libdeps_precise(graph: Graph) -> DataFrame:
    """(archive, extra): declared dependencies, own components aside, none of whose symbols the archive uses."""
    parts = graph.rel("archives_to_components")
    declared = graph.rel("target_to_dependencies").select(F.col("item").alias("archive"), F.col("dep").alias("extra")).distinct().join(parts.select(F.col("item").alias("archive"), F.col("dep").alias("extra")), ["archive", "extra"], "left_anti")
    needed = symbol_info(graph, all_archives(graph), 1).select(F.col("query_id").alias("archive"), "symbol").distinct()
    defined = graph.rel("file_to_symbol_definitions").select(F.col("item").alias("object"), F.col("dep").alias("symbol"))
    held = defined.join(parts.select(F.col("item").alias("extra"), F.col("dep").alias("object")), "object").select("extra", "symbol").union(defined.filter(is_object(F.col("object"))).select(F.col("object").alias("extra"), "symbol")).distinct()
    used = declared.join(held, "extra").join(needed, ["archive", "symbol"], "left_semi").select("archive", "extra").distinct()
    return declared.join(used, ["archive", "extra"], "left_anti")


def render_d3(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result edges as nodes (sources only) and edges (to, from, relationship)."""
    return results.select(F.col("source").alias("id")).distinct(), results.select(F.col("target").alias("to"), F.col("source").alias("from"), "relationship")
