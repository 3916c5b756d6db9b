"""Connected components of an edge table by alternating large and small stars.

Each round points neighbours at the smallest node that a node sees; after O(log^2 n) rounds every component is
a star around its smallest node. Rounds are written to the shared folder. Minima are combined on the map side
and written too, so that the join in which a hub's edges meet its minimum deals out both sides and Spark can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars(edges: DataFrame, scratch: Scratch, name: str = "stars", rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs -> (u, root): every node that isn't the smallest of its component, with that node."""
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{name}0")
    mark = _mark(now)
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}{k}least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # u > v: m is at most the old u
        large = scratch.write(large, f"{name}{k}large")
        down = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}{k}down")
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small, f"{name}{k}")
        seen = _mark(new)
        scratch.drop(f"{name}{k - 1}", f"{name}{k}least", f"{name}{k}large", f"{name}{k}down")
        now = new
        if seen == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
