"""BOM model, limits and frame queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames
from .bom_plans import t
from .room_plans import FEEDS, GRID, cell_validation, riser


def q5(spark, sf):
    sized = t(spark, sf, "supplier").select(F.concat(F.lit("r"), (F.col("s_suppkey") % 6).cast("string")).alias("rule_key"), F.when(F.col("s_suppkey") % 5 != 0, (F.col("s_suppkey") % 7) * 1.0).alias("qty"))
    kinds = t(spark, sf, "part").groupBy(F.col("p_type").alias("type")).agg(F.max(F.when(F.col("p_type") != "PROMO", F.length("p_type"))).alias("ports"))
    li = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("devices"), F.sum("l_quantity").alias("cable_ft"))
    feeds, _ = riser(spark, sf)
    cells = cell_validation(spark, sf).where("error is null").select("tr_name", "category", F.col("value").alias("quantity"))
    allow = t(spark, sf, "nation").select(F.col("n_name").alias("allowance_key"), F.concat(F.lit("allow "), "n_name").alias("item"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") * 1.5).alias("per_unit_qty"), (F.col("n_nationkey") % 3 + 1).alias("unit_count"), (F.col("n_nationkey") % 2 == 0).alias("confirmed"))
    return frames.bom_sections(sized, li.join(kinds, "type"), cells, feeds, allow)


Q5 = f"""{GRID}, {FEEDS}, x AS (SELECT p_type AS type, count(*) AS n, sum(l_quantity) AS ft FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT 'wf6:r' || s_suppkey % 6 AS key, 'r' || s_suppkey % 6 AS item, 'ea' AS unit, sum(CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 7 ELSE 0 END)::DOUBLE AS qty, 'WF6' AS step FROM supplier GROUP BY ALL
UNION ALL SELECT 'wf4:count:' || type, type, 'ea', n::DOUBLE, 'WF4' FROM x UNION ALL SELECT 'wf4:ft:' || type, type || ' cable', 'ft', ft, 'WF4' FROM x
UNION ALL SELECT 'wf4:jacks:' || type, type || ' jacks', 'ea', n * length(type)::DOUBLE, 'WF4' FROM x WHERE type <> 'PROMO'
UNION ALL SELECT 'wf5:' || category, category, CASE WHEN category = 'cable_tray' THEN 'ft' ELSE 'ea' END, floor(sum(coalesce(value, 0)) * 10 + 0.5) / 10, 'WF5' FROM w WHERE error IS NULL AND category <> 'wall_mount' GROUP BY category
UNION ALL SELECT 'wf7:cable:' || n, 'Backbone cable CN ' || n, 'runs', count(*)::DOUBLE, 'WF7' FROM (SELECT a AS n FROM f UNION ALL SELECT b FROM f) WHERE n IS NOT NULL GROUP BY n
UNION ALL SELECT 'wf7:allow:' || n_name, 'allow ' || n_name, 'ea', n_nationkey * 1.5::DOUBLE * (n_nationkey % 3 + 1), 'WF7' FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 2 = 0"""


def limits(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    rules = o.select(F.col("o_custkey").alias("project"), k.alias("seq"), F.when(k % 3 == 0, "bend_limit_deg").otherwise("pull_limit_ft").alias("rule_kind"), F.when(k % 2 == 0, "WF3").otherwise("WF4").alias("used_by_step"), F.when(k % 5 != 0, (k % 700) * 1.0).alias("rule_value"))
    return frames.project_limits(rules, {"osp_pull_ft": 600.0, "interior_pull_ft": 100.0, "bends_deg": 180.0})


LIMITS = """WITH r AS (SELECT o_custkey AS project, o_orderkey AS k, (o_orderkey % 700)::DOUBLE AS v FROM orders), p AS (SELECT DISTINCT project FROM r)
SELECT project, coalesce(arg_min(v, k) FILTER (k % 5 <> 0 AND k % 3 <> 0 AND k % 2 = 0), 600.0)::DOUBLE AS osp_pull_ft, coalesce(arg_min(v, k) FILTER (k % 5 <> 0 AND k % 3 <> 0 AND k % 2 = 1), 100.0)::DOUBLE AS interior_pull_ft, coalesce(arg_min(v, k) FILTER (k % 5 <> 0 AND k % 3 = 0 AND k % 2 = 0), 180.0)::DOUBLE AS bends_deg FROM r GROUP BY project"""


def identity(spark, sf):
    e = t(spark, sf, "events")
    k = F.col("event_id")
    devices = e.select(k.alias("device"), F.col("user_id").alias("page_id"), (k % 16 / 16.0).alias("x"), (k % 8 / 8.0).alias("y"), F.when(k % 3 == 0, "manual").when(k % 3 == 1, "symbol").otherwise("label").alias("xy_source"), F.when(k % 2 == 0, "vector").alias("symbol_via"))
    boxes = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit(0.125).alias("bx"), F.lit(0.25).alias("by"), F.lit(0.5).alias("bw"), F.lit(0.5).alias("bh"))
    return frames.identity_frame(devices, boxes).select("device", "x", "y")


IDENTITY = """WITH d AS (SELECT event_id AS k, user_id AS page, event_id % 16 / 16.0::DOUBLE AS x, event_id % 8 / 8.0::DOUBLE AS y, event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 2 = 1) AS own FROM events),
b AS (SELECT s_suppkey AS page FROM supplier)
SELECT k AS device, CASE WHEN own OR b.page IS NULL THEN x ELSE 0.125 + x * 0.5 END AS x, CASE WHEN own OR b.page IS NULL THEN y ELSE 1 - 0.25 - (1 - y) * 0.5 END AS y FROM d LEFT JOIN b USING (page)"""


def next_signature(spark, sf):
    o = t(spark, sf, "supplier")
    cand = o.select(F.col("s_nationkey").alias("project"), (F.col("s_suppkey") % 9).alias("rank"), F.col("s_name").alias("color"), F.lit(1.0).alias("width"), F.col("s_acctbal").alias("score"))
    from ..operators.bom import first_per

    cand = first_per(cand, ["project", "rank"], F.col("color"))
    cur = t(spark, sf, "nation").select(F.col("n_nationkey").alias("project"), (F.col("n_nationkey") % 5).cast("long").alias("rank"))
    return frames.next_candidate(cand, cur).select("project", "rank", "color", "score", "runner_up")


NEXT_SIGNATURE = """WITH c AS (SELECT s_nationkey AS project, s_suppkey % 9 AS rank, min(s_name) AS color, arg_min(s_acctbal, s_name) AS score FROM supplier GROUP BY ALL)
SELECT c.project, c.rank, c.color, c.score, d.score AS runner_up FROM c JOIN nation ON n_nationkey = c.project AND c.rank = n_nationkey % 5 + 1 LEFT JOIN c d ON d.project = c.project AND d.rank = c.rank + 1"""

PLANS = {"q5_bom_model": (q5, Q5), "project_limits": (limits, LIMITS), "identity_frame": (identity, IDENTITY), "next_signature": (next_signature, NEXT_SIGNATURE)}
