"""Roll-ups of device, usage and room tables by grouping sets and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

NONE = "—"


def countable_pages(pages: DataFrame) -> DataFrame:
    """Plan pages that are no duplicates; only their devices count."""
    return pages.where((F.col("role") == "plan") & ~F.coalesce("is_duplicate", F.lit(False)))


def device_facts(devices: DataFrame, pages: DataFrame, types: DataFrame) -> DataFrame:
    """Devices on countable pages with type name, level and room filled in."""
    plan = countable_pages(pages).select("page_id", F.col("level").alias("page_level"))
    rows = devices.join(plan, "page_id").join(types.select("device_type_id", F.col("name").alias("type")), "device_type_id", "left")
    return rows.withColumns({"type": F.coalesce("type", F.lit("Unknown type")), "level": F.coalesce("level", "page_level", F.lit(NONE)), "tr_name": F.coalesce("tr_name", F.lit(NONE)), "excluded": F.coalesce("excluded", F.lit(False))}).drop("page_level")


def review(facts: DataFrame) -> DataFrame:
    """Counts and lengths by level and type, level, room, page, routing mode and in all, in one pass.

    grouping names the set; the other keys are null. Excluded devices count in excluded only.
    """
    live, feet = ~F.col("excluded"), F.col("route_ft").isNotNull()
    keyed = facts.withColumn("mode", F.when(F.col("route_method") != "none", F.concat_ws("@", "route_method", F.format_string("%.2f", F.coalesce("route_multiplier", F.lit(0.0))))))
    sets = keyed.groupingSets(
        [["level", "type"], ["level"], ["tr_name"], ["page_id"], ["mode"], []], "level", "type", "tr_name", "page_id", "mode"
    ).agg(
        F.grouping_id().alias("gid"), F.count_if(live).alias("devices"), F.count_if(~live).alias("excluded"), S.round_up(F.coalesce(F.sum(F.when(live, F.col("route_ft"))), F.lit(0.0)), 1).alias("cable_ft"),
        F.count_if(live & ~feet).alias("no_length"), F.count_if(live & F.coalesce("tia_flag", F.lit(False))).alias("tia"), F.count_if(live & (F.col("source") == "manual")).alias("manual"),
    )
    names = {0b00111: "level_type", 0b01111: "level", 0b11011: "room", 0b11101: "page", 0b11110: "mode", 0b11111: "total"}
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("gid").cast("int")]
    return sets.withColumn("grouping", name).where((F.col("grouping") != "mode") | F.col("mode").isNotNull()).drop("gid")


def counts_by_level(facts: DataFrame, types: list[str]) -> DataFrame:
    """Devices of each type a level, a column a type, zero where none."""
    return facts.where("not excluded").groupBy("level").pivot("type", types).agg(F.count(F.lit(1))).fillna(0)


def over_limit(facts: DataFrame, default_limit: float = 295.0) -> DataFrame:
    """Devices whose route is longer than their type's limit, with the reason."""
    limit = F.coalesce(F.col("tia_limit_ft"), F.lit(default_limit))
    rows = facts.where(F.col("route_ft") > limit)
    return rows.withColumn("tia_reason", F.concat(F.format_string("%.1f", "route_ft"), F.lit("ft exceeds "), F.format_string("%.0f", limit), F.lit("ft TIA limit")))


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost in all and by org, pass, project, day and page; calls without a price cost nothing now.

    calls: org_id, project_id, page_id, pass, model, input_tokens, output_tokens, cache_read_tokens,
    cache_write_tokens, cost_usd, ok, created_at. prices: model, input_per_mtok, output_per_mtok.
    """
    rows = calls.join(prices, "model", "left").withColumn("day", F.to_date("created_at"))
    cost = S.token_cost(*[F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "input_per_mtok", "output_per_mtok")])
    rows = rows.withColumns({"now": F.coalesce(cost, F.lit(0.0)), "unpriced": F.col("input_per_mtok").isNull()})
    keys = ["org_id", "pass", "project_id", "day", "page_id"]
    sets = rows.groupingSets([[], *[[k] for k in keys]], *keys).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("calls"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        S.round_up(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost_logged"), S.round_up(F.sum("now"), 6).alias("cost_now"), F.count_if("unpriced").alias("unpriced_calls"),
    )
    names = {0b11111: "total"} | {0b11111 ^ (1 << (4 - i)): k for i, k in enumerate(keys)}
    return sets.withColumn("grouping", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("gid").cast("int")]).where((F.col("grouping") != "page_id") | F.col("page_id").isNotNull()).drop("gid")


def split_even(rows: DataFrame, total: str, n: str) -> DataFrame:
    """One row a share: whole totals dealt to n shares, what is left over to the first ones."""
    out = rows.where(F.col(n) > 0).withColumn("share", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return out.withColumn("part", F.floor(F.col(total) / F.col(n)) + F.when(F.col("share") <= F.col(total) % F.col(n), 1).otherwise(0))
