"""Connected components by alternating large-star and small-star steps, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_staged, staged


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))


def _towards(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least of their first node. That table is dealt out first, so that the join has an exchange of its own on
    either side, and adaptive execution can split the edges of a hub."""
    return edges.join(least.repartition("u", "m"), F.col("a") == F.col("u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): component is the smallest id that can be reached.

    Both columns have one orderable type. Null ends and loops are ignored, so isolated nodes are absent; no edges
    give an empty table. Each step is a partly aggregated minimum and a join that adaptive execution can split,
    so a hub node does not end up in one task. Rounds grow with the logarithm of the longest path.
    """
    apart = edges.select("a", "b").filter("a <> b")
    now = staged(apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    seen = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _towards(both, _least(both)).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = _towards(large, down).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(
            down.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
        after = staged(small.distinct())
        drop_staged(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
