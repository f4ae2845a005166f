"""Connected components of an edge table, by alternating large and small stars, in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm._spark import Scratch


def _star(scratch: Scratch, pairs: DataFrame, name: str) -> DataFrame:
    """pairs (u, v): the smallest v of each u. It is written, so that the join that follows can split hot u."""
    return scratch.put(name, pairs.groupBy("u").agg(F.min("v").alias("m")))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v; u > v) that isn't itself its component's smallest node."""
    edges = scratch.put("edges0", edges.select("u", "v").distinct())
    k = 0
    while True:
        k += 1
        # Large star: neighbours larger than u move to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _star(scratch, both, f"large{k}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = scratch.put(f"edges{k}l", large)
        # Small star: u and its smaller neighbours move to the smallest neighbour.
        least = _star(scratch, large, f"small{k}")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = scratch.put(f"edges{k}", moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(f"edges{k - 1}", f"edges{k}l", f"large{k}", f"small{k}")
        edges = new
        # Done once every node hangs on one root alone, which hangs on none.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("root"))
        ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        if ends.groupBy("x").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 or c > 0 and r > 0").isEmpty():
            return edges.select("u", F.col("v").alias("root"))
