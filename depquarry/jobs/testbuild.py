"""The texts of a build out of star-schema tables: a dependency tree per customer, symbol dumps of orders, a log of
declared dependencies. Made by Spark, so they grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import build_text, build_tree
from . import testgraph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id, pos, line): the customer's library with its objects, their sources and headers, the library once more
    as pruned, inline code, a system library, and lines before and after the tree."""
    objects = testgraph.objects(spark, sf_dir).select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), "name")
    customers = objects.select("c").distinct()
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("k", "p_brand").distinct()
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    c, k = F.col("c"), F.col("k")
    frame = F.array(*[F.struct(F.lit(i).alias("a"), line.alias("line")) for i, line in (
        (0, F.lit("reading")), (1, F.lit("+-all")), (2, text("  +-lib", c, ".a")), (4, text("  +-[lib", c, ".a]")), (5, F.lit("  +-")), (6, text("echo ", c)), (7, text("  +-/usr/lib/l", c % 7)), (8, F.lit("done")), (9, text("  +-after", c)),
    )])
    none = [F.lit(0).cast("long").alias("k"), F.lit(0).alias("b"), F.lit("").alias("h")]
    every = [
        customers.select("c", F.explode(frame).alias("x")).select("c", "x.a", *none, "x.line"),
        objects.select("c", F.lit(3).alias("a"), "k", F.lit(0).alias("b"), F.lit("").alias("h"), text("  | +-", F.col("name")).alias("line")),
        objects.select("c", F.lit(3).alias("a"), "k", F.lit(1).alias("b"), F.lit("").alias("h"), text("  | | +-src/o", k, ".cpp").alias("line")),
        objects.join(brands, "k").select("c", F.lit(3).alias("a"), "k", F.lit(2).alias("b"), F.col("p_brand").alias("h"), text("  | | +-", F.col("p_brand"), ".h").alias("line")),
    ]
    lines = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    order = W.partitionBy("c").orderBy("a", "k", "b", "h")
    return lines.select(text("t", c).alias("tree_id"), (F.row_number().over(order) - 1).cast("long").alias("pos"), "line")


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_file, line): a long-form symbol line per line item, and a local symbol and an empty line per object."""
    objects = testgraph.objects(spark, sf_dir).select("o_orderkey", F.col("name").alias("object_file"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(objects, F.col("l_orderkey") == F.col("o_orderkey"))
    column = F.when(F.col("l_quantity") < 49, F.lit(" " * 17 + "U ")).otherwise(F.concat(F.lpad(F.lower(F.hex("l_partkey")), 16, "0"), F.lit(" T ")))
    symbols = items.select("object_file", F.concat(column, F.lit("sym_"), F.col("l_partkey").cast("string")).alias("line"))
    return symbols.unionByName(objects.select("object_file", F.explode(F.array(F.lit("0000000000000000 t .Lloop"), F.lit(""))).alias("line")))


def short_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object_file, line, kind): bare symbol names with blanks around them, and an empty and a local line per object."""
    objects = testgraph.objects(spark, sf_dir).select("o_orderkey", F.col("name").alias("object_file"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(objects, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_quantity") < 49, "used").otherwise("defined").alias("kind")
    named = items.select("object_file", F.concat(F.lit("  sym_"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("line"), kind)
    return named.unionByName(objects.select("object_file", F.explode(F.array(F.lit(" .Lloop"), F.lit(""))).alias("line"), F.lit("defined").alias("kind")))


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, value) of lines that begin like declarations: every third customer's is no JSON, every other third's lacks the list."""
    c = F.col("c_custkey")
    text = F.when(c % 3 == 0, "{no json} after").when(c % 3 == 1, F.concat(F.lit('{"_id": "lib'), c.cast("string"), F.lit('.a"} after')))
    return _table(spark, sf_dir, "customer").filter("c_custkey > 0").select((c * 4 + 3).alias("line_no"), text.alias("value")).filter("value is not null")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, value): declared dependencies as JSON with text after them, other lines between; every fifth customer is declared twice."""
    c = F.col("c_custkey")
    lib = lambda x: F.concat(F.lit("lib"), x.cast("string"), F.lit(".a"))
    declared = lambda *deps: F.concat(F.lit('{"_id": "'), lib(c), F.lit('", "libdeps": ["'), F.array_join(F.array(*deps), '", "'), F.lit('"]} after'))
    lines = F.array(
        F.struct((c * 4).alias("line_no"), declared(lib(F.floor(c / 2)), lib(F.floor(c / 3))).alias("value")),
        F.struct((c * 4 + 1).alias("line_no"), F.concat(F.lit("cc {"), c.cast("string"), F.lit("}")).alias("value")),
        F.struct((c * 4 + 2).alias("line_no"), F.when(c % 5 == 0, declared(lib(F.floor(c / 5)))).alias("value")),
    )
    return _table(spark, sf_dir, "customer").filter("c_custkey > 0").select(F.inline(lines)).filter("value is not null")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_tree.parse_build_tree(tree_lines(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build record per name, as the tree alone tells it."""
    return ingest.dedupe_build_objects(ingest.assemble_build_objects(tree(spark, sf_dir)))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_text.parse_symbol_dump(dump_lines(spark, sf_dir))


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_text.parse_dep_lines(build_text.extract_dep_lines(log_lines(spark, sf_dir)))


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.override_libdeps(ingest.attach_symbols(records(spark, sf_dir), symbols(spark, sf_dir)), declared(spark, sf_dir))
