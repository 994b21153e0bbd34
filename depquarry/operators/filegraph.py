"""The weighted file graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_client, is_object
from ..schema import Graph


def file_graph(graph: Graph, max_definers: int | None = None, with_symbols: bool = True) -> DataFrame:
    """(file, provider, symbols, weight): which objects define what an object uses; objects without edges have a null
    provider. Client objects give no edges but stay as nodes; self edges stay.

    Both sides are distinct before the join, whose hot symbols adaptive execution splits. ``max_definers`` leaves
    symbols with more definers than that to the caller; ``with_symbols=False`` only counts.
    """
    uses = graph.rel("file_to_symbol_dependencies").filter(~is_client(F.col("item"))).select(F.col("item").alias("file"), F.col("dep").alias("symbol")).distinct()
    defs = graph.rel("symbol_to_file_sources").filter(~is_client(F.col("dep"))).select(F.col("item").alias("symbol"), F.col("dep").alias("provider")).distinct()
    if max_definers is not None:
        few = defs.groupBy("symbol").agg(F.count("*").alias("n")).filter(F.col("n") <= max_definers).select("symbol")
        defs = defs.join(few, "symbol", "left_semi")
    symbols = [F.sort_array(F.collect_list("symbol")).alias("symbols")] if with_symbols else []
    edges = uses.join(defs, "symbol").groupBy("file", "provider").agg(*symbols, F.count("*").alias("weight"))
    files = graph.names("file").filter(is_object(F.col("name"))).select(F.col("name").alias("file"))
    return files.join(edges, "file", "left").select("file", "provider", *(["symbols"] if with_symbols else []), F.coalesce("weight", F.lit(0).cast("long")).alias("weight"))
