"""Room, riser, readiness and discovery queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import discover, rooms
from .bom_plans import t

CATEGORIES = ["sleeves", "cable_tray", "wall_mount"]


def cells(spark, sf):
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    category = F.element_at(F.array(*[F.lit(x) for x in [*CATEGORIES, "other"]]), (k % 4 + 1).cast("int"))
    raw = F.when(k % 9 == 0, "").when(k % 9 == 1, "abc").when(k % 9 == 2, "1").when(k % 9 == 3, "-2").otherwise(F.concat((k % 50).cast("string"), F.lit(".25")))
    return c.select(k.alias("seq"), F.when(k % 13 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.concat(F.lit("R"), F.floor(k / 5).cast("string"))).alias("tr_name"), category.alias("category"), raw.alias("raw"))


def the_rooms(spark, sf):
    return t(spark, sf, "customer").select(F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("tr_name"), (F.col("c_custkey") % 3 == 0).alias("done"))


CELLS = """c AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 13 = 0 THEN 'X' || c_custkey ELSE 'R' || c_custkey // 5 END AS tr_name, ['sleeves', 'cable_tray', 'wall_mount', 'other'][c_custkey % 4 + 1] AS category, CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '1' WHEN 3 THEN '-2' ELSE (c_custkey % 50) || '.25' END AS raw FROM customer),
p AS (SELECT *, TRY_CAST(nullif(raw, '') AS DOUBLE) AS n, row_number() OVER (PARTITION BY tr_name, category ORDER BY seq) AS nth FROM c),
q AS (SELECT *, coalesce(n >= 0 AND (category = 'cable_tray' OR n = floor(n)) AND (category <> 'wall_mount' OR n IN (0, 1)), FALSE) AS ok FROM p),
v AS (SELECT *, CASE WHEN tr_name NOT IN (SELECT 'R' || c_custkey FROM customer) THEN 'unknown room' WHEN category = 'other' THEN 'unknown column' WHEN NOT ok AND raw <> '' THEN 'bad value' WHEN nth > 1 THEN 'repeated' END AS error FROM q),
w AS (SELECT seq, tr_name, category, CASE WHEN error IS NULL AND ok AND NOT (category = 'wall_mount' AND n = 0) THEN CASE WHEN category = 'cable_tray' THEN floor(n * 10 + 0.5) / 10 ELSE n END END AS value, error FROM v)"""


def cell_validation(spark, sf):
    return rooms.validate_cells(cells(spark, sf), the_rooms(spark, sf), CATEGORIES)


def room_grid(spark, sf):
    return rooms.grid(the_rooms(spark, sf), cell_validation(spark, sf).where("error is null"), CATEGORIES)


def room_summary(spark, sf):
    return rooms.grid_summary(room_grid(spark, sf).join(the_rooms(spark, sf), "tr_name"), CATEGORIES)


GRID = f"""WITH {CELLS}, r AS (SELECT 'R' || c_custkey AS tr_name, c_custkey % 3 = 0 AS done FROM customer),
g AS (SELECT r.tr_name, any_value(done) AS done, max(value) FILTER (category = 'sleeves') AS sleeves, max(value) FILTER (category = 'cable_tray') AS cable_tray, max(value) FILTER (category = 'wall_mount') AS wall_mount FROM r LEFT JOIN w ON w.tr_name = r.tr_name AND error IS NULL GROUP BY r.tr_name)"""


def riser(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    feeds = o.select(k.alias("feed"), F.when(k % 6 != 0, F.col("o_custkey") % 25).alias("core_a_note"), F.when(k % 4 != 0, k % 25).alias("core_b_note"), F.when(k % 5 != 0, F.concat(F.lit("R"), F.floor(k / 3).cast("string"))).alias("tr_name"), F.when(k % 7 == 0, "added").otherwise("exact").alias("match_kind"))
    cables = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("note_number"), F.when(F.col("n_nationkey") % 4 == 0, "osp").when(F.col("n_nationkey") % 4 < 3, "isp").alias("isp_osp"), F.when(F.col("n_nationkey") != 5, F.concat((F.col("n_nationkey") % 3 * 12).cast("string"), F.lit(" OS2"))).alias("strands_text"))
    return feeds, cables


FEEDS = """f AS (SELECT o_orderkey AS feed, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey % 25 END AS a, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 25 END AS b, CASE WHEN o_orderkey % 5 <> 0 THEN 'R' || o_orderkey // 3 END AS tr, o_orderkey % 7 = 0 AS added FROM orders)"""
RISER = FEEDS + """,
c AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 4 = 0 THEN 'osp' WHEN n_nationkey % 4 < 3 THEN 'isp' END AS p, CASE WHEN n_nationkey <> 5 THEN n_nationkey % 3 * 12 || ' OS2' END AS s FROM nation)"""


def feed_types(spark, sf):
    return rooms.feed_types(*riser(spark, sf))


FEED_TYPES = f"""WITH {RISER}, k AS (SELECT feed, a IS NULL AND b IS NULL AS none, list_distinct(list_filter([x.p, y.p], lambda v: v IS NOT NULL)) AS ks FROM f LEFT JOIN c x ON x.n = a LEFT JOIN c y ON y.n = b)
SELECT feed, CASE WHEN NOT none AND len(ks) = 1 THEN ks[1] END AS isp_osp, CASE WHEN none THEN 'no cable note on either core' WHEN len(ks) > 1 THEN 'core A and core B cables differ in type' WHEN len(ks) = 0 THEN 'cable type not set' END AS why FROM k"""


def head_end(spark, sf):
    feeds, cables = riser(spark, sf)
    calls = t(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("B").alias("core"), F.col("n_nationkey").cast("long").alias("note_number"), (F.col("n_nationkey") * 100).cast("long").alias("qty"))
    return rooms.head_end(calls, feeds, cables)


HEAD_END = f"""WITH {RISER}, h AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS core, n_nationkey AS note_number, n_nationkey * 100 AS qty FROM nation), r AS (SELECT 'A' AS core, a AS n FROM f UNION ALL SELECT 'B', b FROM f),
m AS (SELECT h.core, note_number, qty, count(r.n) AS riser_cores FROM h LEFT JOIN c hc ON hc.n = note_number LEFT JOIN (SELECT r.core, r.n, s, p FROM r JOIN c USING (n)) r ON r.core = h.core AND r.s = hc.s AND r.p IS NOT DISTINCT FROM hc.p AND r.n <> note_number GROUP BY ALL)
SELECT core, note_number, qty, riser_cores, riser_cores = qty AS ok FROM m"""


def feed_counters(spark, sf):
    return rooms.feed_counters(riser(spark, sf)[0], the_rooms(spark, sf))


FEED_COUNTERS = f"""WITH {RISER}, r AS (SELECT 'R' || c_custkey AS tr FROM customer)
SELECT count(*) AS riser, count(tr) AS fed, count(*) - count(tr) AS out, count(*) FILTER (added) AS added, (SELECT count(*) FROM r WHERE tr NOT IN (SELECT tr FROM f WHERE tr IS NOT NULL)) AS schedule_without_feed, (SELECT count(*) FROM (SELECT tr FROM f WHERE tr IS NOT NULL GROUP BY tr HAVING count(*) > 1)) AS duplicates FROM f"""


def readiness(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("confirmed", "open", "confirmed", "stale", "not_applicable", "confirmed", "confirmed")]), ((k + F.floor(k / 8)) % F.when(F.floor(k / 8) % 3 == 0, 1).otherwise(7) + 1).cast("int"))
    steps = o.select(F.floor(k / 8).alias("project"), F.concat(F.lit("WF"), (k % 8 + 1).cast("string")).alias("step"), (k % 8).alias("seq"), status.alias("status"))
    needs = t(spark, sf, "nation").where("n_nationkey between 2 and 8").select(F.concat(F.lit("WF"), F.col("n_nationkey").cast("string")).alias("step"), F.concat(F.lit("WF"), (F.col("n_nationkey") - 1).cast("string")).alias("needs"))
    return rooms.readiness(steps, needs)


READINESS = """WITH s AS (SELECT o_orderkey // 8 AS project, o_orderkey % 8 + 1 AS n, ['confirmed', 'open', 'confirmed', 'stale', 'not_applicable', 'confirmed', 'confirmed'][(o_orderkey + o_orderkey // 8) % CASE WHEN o_orderkey // 8 % 3 = 0 THEN 1 ELSE 7 END + 1] AS st FROM orders),
w AS (SELECT a.project, count(*) AS waiting FROM s a JOIN s b ON a.project = b.project AND b.n = a.n - 1 WHERE a.st <> 'not_applicable' AND b.st NOT IN ('confirmed', 'not_applicable') GROUP BY 1)
SELECT project, coalesce('WF' || min(n) FILTER (st = 'stale'), 'WF' || min(n) FILTER (st <> 'confirmed' AND n < 8), 'WF8') AS next_step, count(*) FILTER (n < 8) > 0 AND count(*) FILTER (n < 8 AND st <> 'confirmed') = 0 AS bom_ready, coalesce(any_value(waiting), 0) AS waiting FROM s LEFT JOIN w USING (project) WHERE st <> 'not_applicable' GROUP BY project"""


def tokens(spark, sf):
    li = t(spark, sf, "lineitem")
    base = F.element_at(F.array(F.lit("DV"), F.lit("CAM"), F.lit("w")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    text = F.when(F.col("l_linenumber") % 3 == 1, F.concat(base, F.lit("-"), (F.col("l_suppkey") % 9).cast("string"))).otherwise(F.concat(base, (F.col("l_suppkey") % 4).cast("string")))
    return li.select((F.col("l_orderkey") % 50).alias("page_id"), F.concat(F.lit(" "), text).alias("str"))


TOKENS = """k AS (SELECT l_orderkey % 50 AS page_id, CASE l_linenumber % 3 WHEN 0 THEN 'DV' || l_suppkey % 4 WHEN 1 THEN 'CAM-' || l_suppkey % 9 ELSE 'W' || l_suppkey % 4 END AS token, ['DV', 'CAM', 'W'][l_linenumber % 3 + 1] AS base FROM lineitem), n AS (SELECT page_id, token, base, count(*) AS n FROM k GROUP BY ALL)"""


def q12(spark, sf):
    counts = discover.token_counts(tokens(spark, sf), ["page_id"])
    pages = counts.select("page_id").distinct()
    wanted = pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("base"), F.lit(a).cast("long").alias("approx")) for n, b, a in (("outlet", "DV", 40), ("outlet", "W", 40), ("camera", "CAM", None))])).alias("c")).select("page_id", "c.*")
    best = discover.best_anchors(counts, wanted, ["page_id"])
    patterns = discover.prefix_pattern(counts, ["page_id"]).select("page_id", "base", "pattern")
    return best.withColumn("base", F.regexp_extract("anchor", "^[A-Z]+", 0)).join(patterns, ["page_id", "base"]).select("page_id", "name", "anchor", "freq", "pattern")


Q12 = rf"""WITH {TOKENS}, b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page_id, base ORDER BY n DESC, token) = 1),
c AS (SELECT *, CASE WHEN base = 'CAM' THEN 'camera' ELSE 'outlet' END AS name, CASE WHEN base = 'CAM' THEN -n ELSE abs(n - 40) END AS gap FROM b)
SELECT page_id, name, token AS anchor, n AS freq, '^' || base || CASE WHEN base = 'CAM' THEN '-[\w-]+$' ELSE '\d+$' END AS pattern FROM c QUALIFY row_number() OVER (PARTITION BY page_id, name ORDER BY gap, token) = 1"""


def matrix_tie(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    page, row = F.floor(k / 6), k % 6
    cells_ = o.select(page.alias("page_id"), row.alias("row"), F.explode(F.array(
        F.struct(F.when(row < 5, F.concat(F.lit("T"), (k % 4).cast("string"))).otherwise(F.lit("GRAND TOTAL:")).alias("str"), F.lit(0.2).alias("x")),
        F.struct((F.when(row < 5, F.col("o_custkey") % 9).otherwise(20)).cast("string").alias("str"), F.lit(0.5).alias("x")),
        F.struct(F.lit("77").alias("str"), F.when(row < 5, 0.8).otherwise(0.9).alias("x")),
    )).alias("c")).select("page_id", "row", "c.*")
    return discover.matrix_ties(discover.matrix(cells_, 0.2, 0.5, 0.05))


MATRIX_TIE = """WITH r AS (SELECT o_orderkey // 6 AS page_id, o_orderkey % 6 AS row, o_custkey % 9 AS q FROM orders), g AS (SELECT page_id, sum(q) FILTER (row < 5) AS total, max(CASE WHEN row = 5 THEN 20 END) AS grand_total FROM r GROUP BY page_id)
SELECT page_id, total::BIGINT AS total, grand_total, coalesce(total = grand_total, FALSE) AS ties FROM g WHERE total IS NOT NULL"""


def noise(spark, sf):
    p = t(spark, sf, "part")
    desc = F.element_at(F.array(F.lit("Dashed gray line"), F.lit("a numbered circle"), F.lit("small arrow"), F.lit("camera glyph")), (F.col("p_partkey") % 4 + 1).cast("int"))
    texts = F.when(F.col("p_size") % 3 != 0, F.array(F.lit("DD"), F.lit("WAP"), F.concat(F.lit("N"), (F.col("p_size") % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    a = discover.expand_anchors(texts)
    return p.select("p_partkey", discover.noise_reason(desc, F.size(texts), F.col("p_size") * 2).alias("reason"), F.array_join(a["primary"], " ").alias("primary_anchors"), F.size(a["associated"]).cast("long").alias("n_associated"))


NOISE = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Conduit or routing line' WHEN p_partkey % 4 = 1 THEN 'Keynote callout or detail reference bubble' WHEN p_partkey % 4 = 2 AND p_size % 3 = 0 THEN 'Directional arrow or flow indicator' WHEN p_size * 2 > 60 AND p_size % 3 = 0 THEN 'High frequency with no text anchors — likely background element' END AS reason,
  CASE WHEN p_size % 3 <> 0 THEN 'DD1 DD2 DD3 WAP N1 N2 N3' ELSE '' END AS primary_anchors, CASE WHEN p_size % 3 <> 0 THEN 6 ELSE 0 END AS n_associated FROM part"""

PLANS = {
    "cell_validation": (cell_validation, f"WITH {CELLS} SELECT seq, tr_name, category, value, error FROM w"), "room_grid": (room_grid, GRID + " SELECT tr_name, sleeves, cable_tray, wall_mount FROM g"),
    "room_summary": (room_summary, GRID + ", h AS (SELECT *, coalesce(sleeves, cable_tray, wall_mount) IS NOT NULL AS has FROM g) SELECT count(*) AS rooms, count(*) FILTER (done) AS done, count(*) FILTER (has) AS with_values, count(*) FILTER (done AND NOT has) AS done_empty, count(*) FILTER (NOT done AND has) AS values_not_done FROM h"),
    "feed_types": (feed_types, FEED_TYPES), "head_end_check": (head_end, HEAD_END), "feed_counters": (feed_counters, FEED_COUNTERS), "workflow_readiness": (readiness, READINESS),
    "q12_discover_anchors": (q12, Q12), "matrix_tie_check": (matrix_tie, MATRIX_TIE), "cluster_noise": (noise, NOISE),
}
