"""All queries over the driver's tables, with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bom_plans, dash_plans, device_plans, merge_plans, model_plans, plant_plans, reach_plans, reading_plans, review_plans, ring_plans, room_plans, small_plans, spatial_plans, takeoff_plans, text_plans, wall_plans

FLAGSHIP = "q4_bom_expand_price"
PLANS = bom_plans.PLANS | dash_plans.PLANS | ring_plans.PLANS | takeoff_plans.PLANS | reach_plans.PLANS | merge_plans.PLANS | spatial_plans.PLANS | device_plans.PLANS | room_plans.PLANS | model_plans.PLANS | plant_plans.PLANS | reading_plans.PLANS | review_plans.PLANS | wall_plans.PLANS | text_plans.PLANS | small_plans.PLANS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PLANS.items() if sql}
