"""Names and types of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The eleven relationships of a build graph.
RELATIONSHIPS = (
    "file_to_symbol_dependencies",
    "symbol_to_file_dependencies",
    "file_to_symbol_definitions",
    "symbol_to_file_sources",
    "file_to_header_includes",
    "header_to_files_including",
    "file_to_source",
    "source_to_file",
    "target_to_dependencies",
    "archives_to_components",
    "dependency_to_targets",
)

EDGES = T.StructType([T.StructField(c, T.StringType()) for c in ("relationship", "item", "dep")])
NODES = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "name")])

_S, _A = T.StringType(), T.ArrayType(T.StringType())
BUILD_OBJECTS = T.StructType([T.StructField(c, t) for c, t in (("_id", _S), ("type", _S), ("source", _S), ("headers", _A), ("symdeps", _A), ("symdefs", _A), ("objects", _A), ("deps", _A), ("inlineCode", _S))])

_GROUP = T.StructType([T.StructField("group_title", _S), T.StructField("group_description", _S), T.StructField("group_files", _A)])
_MODULE = T.StructType([T.StructField("module_name", _S), T.StructField("module_title", _S), T.StructField("module_description", _S), T.StructField("module_groups", T.ArrayType(_GROUP))])
MODULES = T.StructType([T.StructField("system_name", _S), T.StructField("system_title", _S), T.StructField("system_description", _S), T.StructField("system_modules", T.ArrayType(_MODULE))])


@dataclass(frozen=True)
class Graph:
    """A build graph: edges (relationship, item, dep), nodes (kind, name), and a one-row meta table or None."""

    edges: DataFrame
    nodes: DataFrame
    meta: DataFrame | None = None

    def rel(self, name: str) -> DataFrame:
        """(item, dep) of one relationship; the filter prunes partitions of a stored graph."""
        if name not in RELATIONSHIPS:
            raise ValueError(f"no such relationship: {name}")
        return self.edges.filter(F.col("relationship") == name).select("item", "dep")

    def names(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("kind") == kind).select("name")
