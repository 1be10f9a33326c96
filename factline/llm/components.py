"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.session import durable, forget


def _stars(e: DataFrame) -> bool:
    """Whether every edge (u, v) leads to a node v that leads nowhere."""
    return not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).collect()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the smallest node it reaches.

    Edges are written after each round, until they are stars; no row of them comes to the driver. Minima are written
    before they meet the edges, so that adaptive execution can split a hub's edges (it can't where an aggregate stands
    right below the join).
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = durable(e, "edges")
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = durable(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        last, e = e, durable(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(last, low, large, least)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
