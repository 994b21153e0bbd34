"""Connected components of an edge table, by minimum labels with pointer jumping; every round is a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

MAX_ROUNDS = 100


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of long -> (v, l): each node with the smallest node of its component.

    Null ends and self edges are ignored; repeated edges count once; no edges give no rows. Each round's labels are
    written, so lineage stays short and a lost executor repeats one round at most. Pointer jumping keeps the rounds
    near the logarithm of a component's diameter; running out of rounds is an error, never a partial answer.
    """
    both = edges.filter("a is not null and b is not null and a <> b")
    both = written(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("l"), F.lit(True).alias("changed"))
    for _ in range(MAX_ROUNDS):
        labels = written(labels, "labels")
        if not labels.filter("changed").limit(1).count():
            return labels.select("v", "l")
        near = both.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        jump = labels.select(F.col("v").alias("l"), F.col("l").alias("up"))
        labels = (
            labels.join(jump, "l", "left")
            .join(near.withColumnRenamed("a", "v"), "v", "left")
            .select("v", F.least("l", "m", "up").alias("l"), (F.least("l", "m", "up") < F.col("l")).alias("changed"))
        )
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
