"""Outside plant: vault balances, segment checks and quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def primary_callout(callouts: DataFrame) -> DataFrame:
    """The callout with the most cables of each segment, the first of ties."""
    order = Window.partitionBy("segment").orderBy(F.desc("cables"), "seq")
    return callouts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def vault_balance(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, core, trunk, others, legs and category of vaults and junctions whose cable counts don't add up.

    segments: segment, from_node, to_node, core, cables. nodes: node, type. A core with one leg has no
    continuation (unless a leg of the node lacks a callout); else the largest leg must equal the rest.
    """
    ends = segments.select("segment", "core", "cables", F.explode(F.array_distinct(F.array("from_node", "to_node"))).alias("node"))
    ends = ends.join(nodes.where(F.col("type").isin("MH", "HH", "JUNCTION")), "node")
    open_ = ends.groupBy("node").agg(F.count_if(F.col("core").isNull()).alias("missing"))
    sums = ends.where("core is not null").groupBy("node", "type", "core").agg(F.max("cables").alias("trunk"), (F.sum("cables") - F.max("cables")).alias("others"), F.count("*").alias("legs"))
    rows = sums.join(open_, "node")
    category = F.when((F.col("legs") == 1) & (F.col("missing") == 0), "NO CONTINUATION").when((F.col("legs") > 1) & (F.col("trunk") != F.col("others")), F.when(F.col("type") == "JUNCTION", "COUNT CHANGE, NO VAULT").otherwise("COUNT IMBALANCE"))
    return rows.withColumn("category", category).where("category is not null").drop("type", "missing")


def segment_checks(segments: DataFrame, pull_limit: float, bend_limit: float) -> DataFrame:
    """segment, category of everything to verify: loops, missing callouts, mixed callouts, long pulls, bends."""
    loop = F.col("from_node") == F.col("to_node")
    found = F.when(loop, F.array(F.lit("TOPOLOGY"))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("core").isNull(), "MISSING CALLOUT"), F.when(F.col("callouts") > 1, "CONFIG CHANGE MID-RUN"), F.when(F.col("total_ft") > pull_limit, "PULL LENGTH"), F.when(F.col("bends_deg") > bend_limit, "BENDS"),
            ),
            lambda c: c.isNotNull(),
        )
    )
    return segments.select("segment", F.explode(found).alias("category"))


def quantities(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Section, item and quantity a sheet: conditional sums turned into rows."""
    sums = segments.groupBy(*keys).agg(
        F.sum("total_ft").alias("route_ft"), F.sum(F.when(F.col("is_new"), F.col("total_ft")).otherwise(0.0)).alias("new_ft"), F.sum(F.col("total_ft") * F.coalesce("cables", F.lit(0))).alias("cable_ft"),
        F.count_if(F.col("core").isNull()).cast("double").alias("without_callout"), F.count("*").cast("double").alias("segments"),
    )
    return sums.unpivot(keys, ["route_ft", "new_ft", "cable_ft", "without_callout", "segments"], "item", "quantity")


def combine(sheets: DataFrame) -> DataFrame:
    """Quantities of many sheets as one, summed by item."""
    return sheets.groupBy("item").agg(F.sum("quantity").alias("quantity"))
