"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _same(edges: DataFrame, before: DataFrame) -> bool:
    """Both are sets of edges: the same if as many and none is new."""
    return edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (u, v: long).

    Each round hangs neighbours on the smallest node near them; rounds end when edges stay as they
    are, after about the logarithm of the longest path. Edges are checkpointed each round. Self-loops,
    repeats and nulls are dropped; no edges give no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = checkpointed(edges)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # rows are two numbers; of a node with many neighbours Spark splits the join by its skew rule
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        before, edges = edges, checkpointed(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        if _same(edges, before):
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
