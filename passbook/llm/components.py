"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import apart, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: links each node's greater neighbours to its least one; small: its lesser neighbours and itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(apart(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(apart(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a, b) of non-null longs: (node, component), the least node that each node reaches.

    Direction, repeats and loops don't matter. Nodes without another neighbour are not returned.
    Each round halves the longest paths or better; no edges give no rows. Beyond `most` rounds it raises.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(most):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
        if sums == before or sums[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = sums
        now = stored(_stars(_stars(now, large=True), large=False), "edges")
    raise RuntimeError(f"components did not settle in {most} rounds")
