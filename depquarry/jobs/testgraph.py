"""A build graph out of star-schema tables: orders are objects, parts symbols, customers libraries, nations programs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import collect_nodes, edges_of
from ..schema import RELATIONSHIPS, Graph
from ..storage import drop, settled

#: A relationship that is another one's columns swapped, as ``edges_of`` makes them.
_SWAPPED = {"symbol_to_file_dependencies": "file_to_symbol_dependencies", "symbol_to_file_sources": "file_to_symbol_definitions", "header_to_files_including": "file_to_header_includes", "source_to_file": "file_to_source"}


@dataclass(frozen=True)
class KeptGraph(Graph):
    """Each base relationship is written when it is first asked for, and read from there by whoever asks again; the names
    of a kind likewise. ``edges`` and ``nodes`` as a whole are not."""

    kept: dict[str, DataFrame] = field(default_factory=dict)

    def rel(self, name: str) -> DataFrame:
        base = _SWAPPED.get(name, name)
        if base not in self.kept:
            self.kept[base] = settled(super().rel(base), base)
        pairs = self.kept[base]
        return pairs if base == name else pairs.select(F.col("dep").alias("item"), F.col("item").alias("dep"))

    def names(self, kind: str) -> DataFrame:
        if kind not in self.kept:
            of = ("file_to_symbol_dependencies", "file_to_symbol_definitions") + (() if kind == "symbol" else ("file_to_header_includes", "file_to_source", "target_to_dependencies", "archives_to_components"))
            edges = reduce(DataFrame.unionAll, [self.rel(r).select(F.lit(r).alias("relationship"), "item", "dep") for r in of])
            self.kept[kind] = settled(collect_nodes(edges).filter(F.col("kind") == kind).select("name"), kind)
        return self.kept[kind]

    def whole(self) -> Graph:
        """All edges and nodes, from what is written."""
        edges = [self.rel(r).select(F.lit(r).alias("relationship"), "item", "dep") for r in RELATIONSHIPS]
        nodes = [self.names(k).select(F.lit(k).alias("kind"), "name") for k in ("symbol", "file")]
        return Graph(reduce(DataFrame.unionAll, edges), reduce(DataFrame.unionAll, nodes), self.meta)

    def forget(self, *names: str) -> None:
        """Drop what is written of these relationships and kinds."""
        for name in names:
            if name in self.kept:
                drop(self.kept.pop(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lib(key: str):
    return F.concat(F.lit("lib"), F.col(key).cast("string"), F.lit(".a"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, name)."""
    o = _table(spark, sf_dir, "orders")
    flavor = F.when(F.col("o_orderpriority") == "5-LOW", "client_build/").otherwise("")
    test = F.when(F.col("o_orderstatus") == "P", "_test").otherwise("")
    return o.select("o_orderkey", "o_custkey", F.concat(F.lit("build/"), flavor, F.lit("o"), F.col("o_orderkey").cast("string"), test, F.lit(".o")).alias("name"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    obj = objects(spark, sf_dir)
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    named = lines.join(obj.select("o_orderkey", "name"), F.col("l_orderkey") == F.col("o_orderkey"))
    symbol = F.concat(F.lit("sym_"), F.col("l_partkey").cast("string"))
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    below = customer.filter("c_custkey > 0").select(_lib("c_custkey").alias("item"), F.explode(F.expr("array(c_custkey div 2, c_custkey div 3)")).alias("low")).select("item", _lib("low").alias("dep"))
    programs = customer.filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("prog"), F.col("c_nationkey").cast("string")).alias("item"), _lib("c_custkey").alias("dep"))
    edges = edges_of(
        symdeps=named.filter("l_quantity < 49").select(F.col("name").alias("item"), symbol.alias("dep")),
        symdefs=named.filter("l_quantity >= 49").select(F.col("name").alias("item"), symbol.alias("dep")),
        headers=lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").join(obj.select("o_orderkey", "name"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("name").alias("item"), F.concat("p_brand", F.lit(".h")).alias("dep")),
        source=obj.select(F.col("name").alias("item"), F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".cpp")).alias("dep")),
        deps=below.union(programs),
        objects=obj.select(_lib("o_custkey").alias("item"), F.col("name").alias("dep")),
    )
    return KeptGraph(edges, collect_nodes(edges))


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, bucket): programs by region, those of the first region in none."""
    n = _table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("prog"), F.col("n_nationkey").cast("string")).alias("name"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("region"), F.col("n_regionkey").cast("string"))).alias("bucket"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat hierarchy with titles and descriptions: system = region, module = nation, group = market segment, files = sources of its customers' orders."""
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.col("r_regionkey").alias("system_pos"), F.lower("r_name").alias("system_name"), F.col("n_nationkey").alias("module_pos"), F.lower("n_name").alias("module_name"),
        F.ascii("c_mktsegment").alias("group_ord"), F.col("c_mktsegment").alias("group_title"), F.col("o_orderkey").alias("file_pos"), F.concat(F.lit("src/o"), F.col("o_orderkey").cast("string"), F.lit(".cpp")).alias("file"),
        F.concat(F.lit("System "), "r_name").alias("system_title"), F.concat(F.lit("What # "), F.lower("r_name"), F.lit("_does.\nMore.")).alias("system_description"), F.concat(F.lit("Module "), "n_name").alias("module_title"),
        F.concat(F.lit("All of "), F.lower("n_name"), F.lit("_code.")).alias("module_description"), F.concat(F.lit("Files_of "), "c_mktsegment").alias("group_description"),
    )
