"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.session import materialise


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u, v`` with ``m``, the least of u and all its neighbours v. The minimum is taken before anything is shuffled."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge has u > v, so m is the least neighbour and stands for u itself too.
    found = _with_least(edges)
    return found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        found.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable, for every node that has an edge other than to itself.

    Each round is a stored table; rounds grow with the logarithm of the longest path. No node's neighbours are ever
    gathered: stars only take minima and join them back, and hot join keys are split by AQE.
    """
    now = materialise(
        edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "edges")
    mark = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))
    last = now.select(mark).first()
    while True:
        now = materialise(_small_star(_large_star(now)), "stars")
        state = now.select(mark).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        last = state
