"""Column expressions on the names of build objects. Matching is bytewise and case-sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What the end of a name tells, the first that holds.
SUFFIXES = ((".h", "header"), (".o", "object"), (".a", "archive"), (".js", "javascript"))


def detect_type(name: Column) -> Column:
    """header, object, archive, javascript, system or target; the first rule that holds counts."""
    out = F
    for suffix, kind in SUFFIXES:
        out = out.when(name.endswith(suffix), kind)
    return out.when(name.startswith("/"), "system").otherwise("target")


def child_type(parent: str, ordinal: int, name: str) -> str:
    """For one node: under an object the first child is its source and the rest headers, under an archive every child is
    an object, else the name tells. A type hangs on the parent's, so the parse of a tree tells it on the way down."""
    if parent == "object":
        return "source" if ordinal == 1 else "header"
    if parent == "archive":
        return "object"
    return next((kind for suffix, kind in SUFFIXES if name.endswith(suffix)), "system" if name.startswith("/") else "target")


def is_object(name: Column) -> Column:
    return name.endswith(".o")


def is_client(name: Column) -> Column:
    return name.contains("client_build")


def joined(items: Column, sep: str = ",") -> Column:
    """A set as sorted text."""
    return F.array_join(F.sort_array(items), sep)
