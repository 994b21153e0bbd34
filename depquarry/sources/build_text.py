"""Text of a build: log lines with declared dependencies, dependency trees, symbol dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ingest import assemble_build_objects, attach_symbols, dedupe_build_objects, override_libdeps


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines numbered from 0 in their file, however many tasks read it. Two passes: the lines of
    every split are counted, their running sum gives each split its first number (a row a split), then lines get theirs."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    counts = rows.groupBy("file", "split").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("split")
    bases = counts.select("file", "split", (F.sum("n").over(before) - F.col("n") - F.col("_first")).alias("_base"))
    return rows.join(bases, ["file", "split"]).select("file", (F.col("_at") + F.col("_base")).alias("line_no"), "value")


def extract_dep_lines(lines: DataFrame) -> DataFrame:
    """(…, value) -> (…, json): the JSON object at a line's start, up to the line's last closing brace."""
    return lines.withColumn("json", F.regexp_extract("value", r"^(\{.*\}).*", 1)).filter("json <> ''").drop("value")


def parse_dep_lines(found: DataFrame, mode: str = "fail") -> DataFrame:
    """(line_no, json) -> (line_no, _id, libdeps[, bad]); ``mode='fail'`` raises on bad JSON or missing fields,
    ``'quarantine'`` keeps such lines with ``bad`` set."""
    row = F.from_json("json", "_id string, libdeps array<string>")
    out = found.select("line_no", "json", row.alias("r")).select("line_no", "json", "r._id", "r.libdeps").withColumn("bad", F.col("_id").isNull() | F.col("libdeps").isNull())
    if mode == "quarantine":
        return out
    if mode != "fail":
        raise ValueError("mode: fail or quarantine")
    # the optimizer may ask this of rows that extract_dep_lines leaves out, so their empty text must not raise
    checked = F.when(F.col("bad") & (F.col("json") != ""), F.raise_error(F.concat(F.lit("bad dependency line: "), "json")).cast("string")).otherwise(F.col("_id"))
    return out.select("line_no", checked.alias("_id"), "libdeps")


def parse_symbol_dump(lines: DataFrame, platform: str = "linux") -> DataFrame:
    """(object_file, line[, kind]) of an already demangled dump -> (object_file, symbol, kind used/defined).

    With the long form the letter ``U`` in its column tells used symbols; the short form has the bare name and says
    its ``kind``. Empty lines and local symbols (``.L``) are dropped.
    """
    lines = lines.filter("line <> ''")
    if platform == "linux":
        kind = F.when(F.substring("line", 18, 2) == "U ", "used").otherwise("defined")
        out = lines.select("object_file", F.expr("substring(line, 20)").alias("symbol"), kind.alias("kind"))
    else:
        out = lines.select("object_file", F.trim("line").alias("symbol"), "kind")
    return out.filter(~F.col("symbol").startswith(".L"))


def build_records(tree: DataFrame, symbols: DataFrame, libdeps: DataFrame) -> DataFrame:
    """Tree rows, symbols and declared dependencies -> one build record per ``_id``."""
    return override_libdeps(attach_symbols(dedupe_build_objects(assemble_build_objects(tree)), symbols), libdeps)
