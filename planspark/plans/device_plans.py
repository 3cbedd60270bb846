"""Reconciliation, geometry and outside-plant queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry, osp, reconcile
from .bom_plans import t

# stand-ins: customers are numbered devices on a lattice of their own; events are labels and symbols


def evidence(spark, sf):
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    page, x, y, kind = (k % 30), (k % 100) * 1.0, F.floor(k / 100) * 1.0, F.concat(F.lit("T"), (k % 3).cast("string"))
    uin = F.concat(F.lit("U"), k.cast("string"))
    schedule = c.where("c_custkey % 4 <> 3").select(page.alias("page_id"), uin.alias("uin"), kind.alias("type"), x.alias("sx"), y.alias("sy"))
    labels = c.where("c_custkey % 5 <> 4").select(page.alias("page_id"), k.alias("seq"), F.when(k % 7 != 0, uin).alias("uin"), F.when(k % 11 == 0, "T9").otherwise(kind).alias("type"), (x + F.when(k % 6 == 0, 0.0).otherwise(0.3)).alias("x"), y.alias("y"), F.lit(True).alias("in_region"))
    symbols = c.where("c_custkey % 2 = 0").select(page.alias("page_id"), k.alias("sym"), kind.alias("type"), (x + 0.31).alias("x"), y.alias("y"))
    return schedule, labels, symbols


def q1(spark, sf):
    got = reconcile.count_devices(*evidence(spark, sf))
    return got.groupBy("page_id", "type", "confidence", "xy_source", F.array_join(F.array_sort("flags"), ",").alias("flags")).agg(F.count("*").alias("devices"))


def snap_stand_ins(spark, sf):
    """Twelve customers to a page: the first nine are devices 15 apart (one in three without a place), all are symbols between them."""
    c = t(spark, sf, "customer")
    k, page, y = F.col("c_custkey"), F.floor(F.col("c_custkey") / 12), F.lit(0.0)
    n, kind = k % 12, F.concat(F.lit("T"), (F.floor(k / 12) % 2).cast("string"))
    placed = k % 3 != page % 3
    some = [page.alias("page_id"), F.lpad(k.cast("string"), 9, "0").alias("device"), F.lit(None).cast("string").alias("uin"), kind.alias("type"), F.when(placed, n * 15.0).alias("x"), F.when(placed, y).alias("y")]
    devices = c.where("c_custkey % 12 < 9").select(*some, F.when(placed, "label").otherwise("none").alias("xy_source"), F.array(F.when(placed, "label").otherwise("schedule")).alias("sources"), F.array().cast("array<string>").alias("flags"))
    symbols = c.select(page.alias("page_id"), k.alias("sym"), kind.alias("type"), ((k * 7 + page) % 12 * 13.0 + page % 5).alias("x"), y.alias("y"))
    return devices, symbols


def snap_order(spark, sf):
    got = reconcile.snapped(*snap_stand_ins(spark, sf), 20.0)
    return got.select("page_id", "device", "type", "x", "xy_source", F.array_join("sources", ",").alias("sources"), F.array_join("flags", ",").alias("flags"))


# one symbol of each page a step; the page's devices are a list that each step gives anew
SNAP_ORDER = """WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey // 12 AS page_id, c_custkey % 12 AS n FROM customer),
s AS (SELECT k, page_id, ((k * 7 + page_id) % 12) * 13.0::DOUBLE + page_id % 5 AS x, row_number() OVER (PARTITION BY page_id ORDER BY k) AS step FROM c),
d AS (SELECT page_id, list({'device': lpad(k::VARCHAR, 9, '0'), 'x': CASE WHEN k % 3 <> page_id % 3 THEN n * 15.0::DOUBLE END, 'listed': k % 3 = page_id % 3, 'moved': false, 'adopted': false, 'fresh': false} ORDER BY k) FILTER (n < 9) AS held FROM c GROUP BY page_id),
r AS (SELECT page_id, 0::BIGINT AS step, coalesce(held, []) AS held FROM d
UNION ALL SELECT page_id, step, CASE WHEN near IS NOT NULL THEN list_transform(held, lambda h: CASE WHEN h.device = near THEN {'device': h.device, 'x': sx, 'listed': h.listed, 'moved': true, 'adopted': h.adopted, 'fresh': h.fresh} ELSE h END)
  WHEN free IS NOT NULL THEN list_transform(held, lambda h: CASE WHEN h.device = free THEN {'device': h.device, 'x': sx, 'listed': true, 'moved': true, 'adopted': true, 'fresh': false} ELSE h END)
  ELSE list_append(held, {'device': 's:' || k, 'x': sx, 'listed': false, 'moved': true, 'adopted': false, 'fresh': true}) END
  FROM (SELECT r.page_id, s.step, s.k, s.x AS sx, r.held, list_min(list_transform(list_filter(r.held, lambda h: h.x IS NULL), lambda h: h.device)) AS free,
    (SELECT max_by(u.h.device, {'d': -abs(u.h.x - s.x), 'n': u.h.device}) FROM (SELECT unnest(r.held) AS h) u WHERE u.h.x IS NOT NULL AND NOT u.h.fresh AND abs(u.h.x - s.x) <= 20) AS near FROM r JOIN s ON s.page_id = r.page_id AND s.step = r.step + 1)),
last AS (SELECT page_id, unnest(held) AS h FROM r QUALIFY step = max(step) OVER (PARTITION BY page_id))
SELECT page_id, h.device AS device, 'T' || page_id % 2 AS type, h.x AS x, CASE WHEN h.moved THEN 'symbol' WHEN h.x IS NULL THEN 'none' ELSE 'label' END AS xy_source,
  concat_ws(',', CASE WHEN h.fresh THEN NULL WHEN h.listed THEN 'schedule' ELSE 'label' END, CASE WHEN h.moved THEN 'symbol' END) AS sources, CASE WHEN h.fresh THEN 'no_uin' WHEN h.adopted THEN 'placement_inferred' ELSE '' END AS flags FROM last"""


def label_placement(spark, sf):
    schedule, labels, _ = evidence(spark, sf)
    got = reconcile.placed_by_label(schedule, labels)
    return got.select("uin", "type", "xy_source", F.array_join("sources", ",").alias("sources"), F.array_join("flags", ",").alias("flags"), F.floor(F.col("x") * 10 + 0.5).cast("long").alias("x10"))


LABEL_PLACEMENT = """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 <> 3 AS listed, c_custkey % 5 <> 4 AND c_custkey % 7 <> 0 AS label, c_custkey % 6 = 0 AS echo FROM customer),
d AS (SELECT *, label AND NOT (listed AND echo) AS placed FROM c WHERE listed OR label)
SELECT 'U' || k AS uin, CASE WHEN NOT listed AND k % 11 = 0 THEN 'T9' ELSE 'T' || k % 3 END AS type, CASE WHEN placed THEN 'label' ELSE 'none' END AS xy_source, concat_ws(',', CASE WHEN listed THEN 'schedule' END, CASE WHEN placed THEN 'label' END) AS sources,
  concat_ws(',', CASE WHEN listed AND placed AND k % 11 = 0 THEN 'type_conflict' END, CASE WHEN NOT listed THEN 'not_in_schedule' END) AS flags, CASE WHEN placed THEN (k % 100) * 10 + CASE WHEN k % 6 = 0 THEN 0 ELSE 3 END END AS x10 FROM d"""


def strokes(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("path"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq")).select("path", "seq", ((F.col("seq") * (F.col("path") % 5 + 1)) % 8 * 1.0).alias("x"), ((F.col("seq") * F.col("seq") + F.col("path")) % 7 * 1.0).alias("y"))


STROKES = "v AS (SELECT o_orderkey AS path, s AS seq, (s * (o_orderkey % 5 + 1)) % 8 * 1.0::DOUBLE AS x, (s * s + o_orderkey) % 7 * 1.0::DOUBLE AS y FROM orders, (SELECT unnest(range(0, 8)) AS s))"


def areas(spark, sf):
    return geometry.polygons(strokes(spark, sf), ["path"]).select("path", "area", S.round_up("cx", 3).alias("cx"), "x0", "y1", "n")


AREAS = f"""WITH {STROKES}, c AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM v WINDOW w AS (PARTITION BY path ORDER BY seq))
SELECT path, abs(sum(x * ny - y * nx)) / 2 AS area, floor(avg(x) * 1000 + 0.5) / 1000 AS cx, min(x) AS x0, max(y) AS y1, count(*) AS n FROM c GROUP BY path"""


def circle_test(spark, sf):
    return geometry.circles(strokes(spark, sf), ["path"], 0.4).select("path", "n", S.round_up("radius", 2).alias("radius"))


CIRCLES = f"""WITH {STROKES}, c AS (SELECT *, avg(x) OVER (PARTITION BY path) AS cx, avg(y) OVER (PARTITION BY path) AS cy FROM v), r AS (SELECT path, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM c)
SELECT path, count(*) AS n, floor(avg(r) * 100 + 0.5) / 100 AS radius FROM r GROUP BY path HAVING avg(r) > 0 AND stddev_pop(r) / avg(r) <= 0.4"""


def gap_percentile(spark, sf):
    return geometry.nth_value(t(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", 0.25, "q25")


GAP_PERCENTILE = "WITH s AS (SELECT l_suppkey, list_sort(list(l_quantity)) AS a FROM lineitem GROUP BY 1) SELECT l_suppkey, a[floor(len(a) * 0.25)::BIGINT + 1] AS q25 FROM s"


def width_classes(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", (F.col("l_discount") * 100).cast("int").alias("width"), F.col("l_quantity").alias("length"))
    return geometry.dominant_width(rows, ["l_returnflag", "l_suppkey"])


WIDTHS = "WITH s AS (SELECT l_returnflag, l_suppkey, (trunc(l_discount * 100))::INT AS width, sum(l_quantity) AS t FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_suppkey, width FROM s QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_suppkey ORDER BY t DESC, width DESC) = 1"


def segments(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("segment"), F.col("o_custkey").alias("from_node"), (F.col("o_custkey") + k % 7 - 3).alias("to_node"), F.when(k % 10 != 0, F.when(k % 2 == 0, "A").otherwise("B")).alias("core"), (F.col("o_custkey") % 5 + 1).alias("cables"), (k % 9 == 0).alias("is_new"), F.floor(F.col("o_totalprice") / 500).cast("double").alias("total_ft"), (F.col("o_custkey") % 400).alias("bends_deg"), (k % 4 + 1).alias("callouts"), F.col("o_orderpriority").alias("sheet"))


SEGMENTS = "s AS (SELECT o_orderkey AS segment, o_custkey AS f, o_custkey + o_orderkey % 7 - 3 AS g, CASE WHEN o_orderkey % 10 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END END AS core, o_custkey % 5 + 1 AS cables, o_orderkey % 9 = 0 AS is_new, floor(o_totalprice / 500)::DOUBLE AS ft, o_custkey % 400 AS deg, o_orderkey % 4 + 1 AS callouts, o_orderpriority AS sheet FROM orders)"


def vaults(spark, sf):
    nodes = t(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") % 3 == 0, "JUNCTION").when(F.col("c_custkey") % 3 == 1, "MH").otherwise("END").alias("type"))
    return osp.vault_balance(segments(spark, sf), nodes)


VAULTS = f"""WITH {SEGMENTS}, e AS (SELECT f AS node, core, cables FROM s UNION ALL SELECT g, core, cables FROM s WHERE f <> g), n AS (SELECT e.*, CASE c_custkey % 3 WHEN 0 THEN 'JUNCTION' ELSE 'MH' END AS type FROM e JOIN customer ON c_custkey = node WHERE c_custkey % 3 < 2),
m AS (SELECT node, count(*) FILTER (core IS NULL) AS missing FROM n GROUP BY node), a AS (SELECT node, type, core, max(cables) AS trunk, (sum(cables) - max(cables))::BIGINT AS others, count(*) AS legs FROM n WHERE core IS NOT NULL GROUP BY ALL)
SELECT node, core, trunk, others, legs, CASE WHEN legs = 1 THEN 'NO CONTINUATION' WHEN type = 'JUNCTION' THEN 'COUNT CHANGE, NO VAULT' ELSE 'COUNT IMBALANCE' END AS category FROM a JOIN m USING (node) WHERE (legs = 1 AND missing = 0) OR (legs > 1 AND trunk <> others)"""


def segment_flags(spark, sf):
    return osp.segment_checks(segments(spark, sf), 500.0, 270.0)


SEGMENT_FLAGS = f"""WITH {SEGMENTS} SELECT segment, unnest(CASE WHEN f = g THEN ['TOPOLOGY'] ELSE list_filter([CASE WHEN core IS NULL THEN 'MISSING CALLOUT' END, CASE WHEN callouts > 1 THEN 'CONFIG CHANGE MID-RUN' END, CASE WHEN ft > 500 THEN 'PULL LENGTH' END, CASE WHEN deg > 270 THEN 'BENDS' END], lambda c: c IS NOT NULL) END) AS category FROM s"""


def q9(spark, sf):
    rows = osp.quantities(segments(spark, sf), ["sheet"])
    return rows.unionByName(osp.combine(rows).withColumn("sheet", F.lit("all")))


Q9 = f"""WITH {SEGMENTS}, r AS (SELECT sheet, sum(ft) AS route_ft, sum(CASE WHEN is_new THEN ft ELSE 0 END) AS new_ft, sum(ft * cables) AS cable_ft, count(*) FILTER (core IS NULL)::DOUBLE AS without_callout, count(*)::DOUBLE AS segments FROM s GROUP BY sheet),
u AS (UNPIVOT r ON route_ft, new_ft, cable_ft, without_callout, segments INTO NAME item VALUE quantity) SELECT sheet, item, quantity FROM u UNION ALL SELECT 'all', item, sum(quantity) FROM u GROUP BY item"""


def simplified(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return geometry.simplify(e, ["user_id"], 20.0).groupBy("user_id").agg(F.count("*").alias("vertices"), F.sum("seq").alias("ids"))


PLANS = {
    "q1_count_devices": (q1, None), "snap_order": (snap_order, SNAP_ORDER), "label_placement": (label_placement, LABEL_PLACEMENT), "polygon_areas": (areas, AREAS), "circle_test": (circle_test, CIRCLES), "gap_percentile": (gap_percentile, GAP_PERCENTILE), "dominant_width": (width_classes, WIDTHS),
    "vault_balance": (vaults, VAULTS), "segment_checks": (segment_flags, SEGMENT_FLAGS), "q9_plant_quantities": (q9, Q9), "simplified_polylines": (simplified, None),
}
