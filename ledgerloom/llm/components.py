"""Connected components by alternating large and small stars, stored between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, salted_join


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on ``edges(a, b)`` with a > b: each node's partners are linked to its least partner."""
    both = edges.union(edges.select("b", "a")) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = salted_join(both, least, "a", "b")  # a star's centre is a hot key
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        # Each node keeps its link to the least; partners above the least are linked to it as well.
        moved = joined.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)`` (longs); the component is its least node.

    A node with many links is never gathered: least partners are aggregated before the shuffle, and joins deal a
    node's links over up to 32 tasks. Rounds grow with the logarithm of the longest path. Null ends and loops are ignored.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    while not _is_stars(now):
        new = materialize(_stars(_stars(now, True), False), "edges")
        discard(now)
        now = new
    # Each node hangs on its component's least.
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    out._ledgerloom_path = now._ledgerloom_path  # the caller discards it
    return out


def _is_stars(edges: DataFrame) -> bool:
    """Whether each ``a`` has one link, and none is a centre ``b`` as well."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(False).alias("centre")).union(edges.select("b", F.lit(0), F.lit(True)))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("centre").alias("centre")).where("n > 1 OR (n = 1 AND centre)").isEmpty()
