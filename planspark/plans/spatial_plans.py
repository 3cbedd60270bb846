"""Spatial, island, graph and prototype queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bom, classify, graph, islands, merge, spatial
from ..sources import imports, sinks
from .bom_plans import t

# stand-ins: an event is a point on a page (its user) at places that its ids give, on a grid of 1000 x 1000


def points(spark, sf, mark: str):
    e = t(spark, sf, "events")
    return e.select((F.col("user_id") % 40).alias("page_id"), "event_id", ((F.col("event_id") * 7919) % 1000).cast("double").alias("x"), ((F.col("event_id") * 104729) % 1000).cast("double").alias("y"), F.col("event_type").alias("type")).where(mark)


POINTS = """pt AS (SELECT user_id % 40 AS page_id, event_id, (event_id * 7919) % 1000 AS xi, (event_id * 104729) % 1000 AS yi, event_type AS type FROM events)"""


def symbol_snap(spark, sf):
    devices = points(spark, sf, "event_id % 5 <> 0").select("page_id", "type", F.col("event_id").alias("device"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    got = spatial.nearest(points(spark, sf, "event_id % 5 = 0"), devices, 50.0, ["page_id", "type"], ["event_id"], F.col("device"))
    return got.select("event_id", "device", F.floor(F.col("dist") * 1000 + 0.5).cast("long").alias("micro"))


SYMBOL_SNAP = f"""WITH {POINTS}, p AS (SELECT a.event_id, b.event_id AS device, (a.xi - b.xi) ** 2 + (a.yi - b.yi) ** 2 AS d2 FROM pt a JOIN pt b ON a.page_id = b.page_id AND a.type = b.type AND a.event_id % 5 = 0 AND b.event_id % 5 <> 0)
SELECT event_id, device, floor(sqrt(d2) * 1000 + 0.5)::BIGINT AS micro FROM p WHERE d2 <= 2500 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d2, device) = 1"""


def family_attach(spark, sf):
    anchors = points(spark, sf, "type = 'click'").select("page_id", F.col("event_id").alias("anchor"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    got = spatial.nearest(points(spark, sf, "type = 'view'"), anchors, 30.0, ["page_id"], ["event_id"], F.col("anchor"), strict=True)
    return got.groupBy("anchor").agg(F.count("*").alias("tokens"), F.min("event_id").alias("first_token"))


FAMILY_ATTACH = f"""WITH {POINTS}, p AS (SELECT a.event_id, b.event_id AS anchor, (a.xi - b.xi) ** 2 + (a.yi - b.yi) ** 2 AS d2 FROM pt a JOIN pt b ON a.page_id = b.page_id AND a.type = 'view' AND b.type = 'click'),
n AS (SELECT * FROM p WHERE d2 < 900 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d2, anchor) = 1) SELECT anchor, count(*) AS tokens, min(event_id) AS first_token FROM n GROUP BY anchor"""


def manual_suppression(spark, sf):
    manual = points(spark, sf, "event_id % 9 = 0").select("page_id", "type", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.suppressed(points(spark, sf, "event_id % 9 <> 0"), manual, 15.5, ["page_id", "type"], ["event_id"]).groupBy("page_id").agg(F.count("*").alias("devices"), F.sum("event_id").alias("ids"))


MANUAL = f"""WITH {POINTS} SELECT page_id, count(*) AS devices, sum(event_id)::BIGINT AS ids FROM pt a WHERE event_id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM pt b WHERE b.event_id % 9 = 0 AND a.page_id = b.page_id AND a.type = b.type AND (a.xi - b.xi) ** 2 + (a.yi - b.yi) ** 2 <= 240.25) GROUP BY page_id"""


def count_tokens(spark, sf):
    tokens = points(spark, sf, "event_id % 2 = 1").select("page_id", F.col("event_id").alias("token"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return spatial.left_adjacent(points(spark, sf, "event_id % 2 = 0"), tokens, 40.5, 10.5, ["page_id"], ["event_id"], F.col("token")).select("event_id", "token")


COUNT_TOKENS = f"""WITH {POINTS} SELECT a.event_id, b.event_id AS token FROM pt a JOIN pt b ON a.page_id = b.page_id AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND a.xi - b.xi BETWEEN 1 AND 40 AND abs(a.yi - b.yi) <= 10
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY (a.xi - b.xi) ** 2 + (a.yi - b.yi) ** 2, b.xi, b.event_id) = 1"""


def pin_assign(spark, sf):
    s = t(spark, sf, "supplier")
    k = F.col("s_suppkey")
    pins = s.select((k % 40).alias("page_id"), k.alias("near_pin"), ((k * 389) % 1000).cast("double").alias("rx"), ((k * 577) % 1000).cast("double").alias("ry"))
    boxes = pins.where("near_pin % 3 = 0").select("page_id", F.col("near_pin").alias("pin_id"), F.col("near_pin").alias("pin_order"), (F.col("rx") - 100.5).alias("x0"), (F.col("ry") - 100.5).alias("y0"), (F.col("rx") + 100.5).alias("x1"), (F.col("ry") + 100.5).alias("y1"))
    got = spatial.assign_pins(points(spark, sf, "true"), boxes, pins, 100.0, 1500.0, ["page_id"], ["event_id"])
    return got.select("event_id", "pin", "scoped")


PIN_ASSIGN = f"""WITH {POINTS}, pin AS (SELECT s_suppkey % 40 AS page_id, s_suppkey AS pin, (s_suppkey * 389) % 1000 AS px, (s_suppkey * 577) % 1000 AS py FROM supplier),
j AS (SELECT event_id, pin, (xi - px) ** 2 + (yi - py) ** 2 AS d2, pin % 3 = 0 AND abs(xi - px) <= 100 AND abs(yi - py) <= 100 AS boxed FROM pt LEFT JOIN pin USING (page_id)),
g AS (SELECT event_id, min(pin) FILTER (boxed) AS box_pin, arg_min(pin, d2 * 1000000 + pin) AS near_pin FROM j GROUP BY event_id) SELECT event_id, coalesce(box_pin, near_pin) AS pin, box_pin IS NOT NULL AS scoped FROM g"""


def exclusion_zones(spark, sf):
    n = t(spark, sf, "nation")
    k = F.col("n_nationkey")
    boxes = n.select((k % 40).cast("long").alias("page_id"), k.alias("zone"), (k * 37 % 1000 - 0.5).alias("x0"), (k * 91 % 1000 - 0.5).alias("y0"), (k * 37 % 1000 + 200.5).alias("x1"), (k * 91 % 1000 + 300.5).alias("y1"))
    inside = spatial.in_boxes(points(spark, sf, "true"), boxes, 100.0, ["page_id"]).select("event_id").distinct()
    return points(spark, sf, "true").join(inside, "event_id", "left_anti").groupBy("page_id", "type").agg(F.count("*").alias("kept"))


ZONES = f"""WITH {POINTS}, z AS (SELECT n_nationkey % 40 AS page_id, n_nationkey * 37 % 1000 AS zx, n_nationkey * 91 % 1000 AS zy FROM nation)
SELECT page_id, type, count(*) AS kept FROM pt WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.page_id = pt.page_id AND xi BETWEEN zx AND zx + 200 AND yi BETWEEN zy AND zy + 300) GROUP BY ALL"""


def greedy_dedup(spark, sf):
    pts = points(spark, sf, "true").select("page_id", "type", F.col("event_id").alias("id"), "x", "y")
    return graph.greedy_keep(pts, 50.5, ["page_id", "type"]).groupBy("page_id", "type").agg(F.count("*").alias("kept"), F.sum("id").alias("ids"))


def q2(spark, sf):
    """Locate devices, drop those that manual ones cover, assign pins and measure."""
    s = t(spark, sf, "supplier")
    k = F.col("s_suppkey")
    pins = s.select((k % 40).alias("page_id"), k.alias("near_pin"), ((k * 389) % 1000).cast("double").alias("rx"), ((k * 577) % 1000).cast("double").alias("ry"))
    manual = points(spark, sf, "event_id % 9 = 0").select("page_id", "type", F.col("x").alias("rx"), F.col("y").alias("ry"))
    found = spatial.suppressed(points(spark, sf, "event_id % 9 <> 0"), manual, 15.5, ["page_id", "type"], ["event_id"])
    near = spatial.nearest_outward(found, pins, 100.0, 1500.0, ["page_id"], ["event_id"], F.col("near_pin"))
    points_long = spatial.route(F.lit("right_angle"), F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    length = S.length_ft(points_long, F.lit(8.0), F.lit(1.5), F.lit(10.0))
    rows = near.select("page_id", "type", "near_pin", length.alias("l")).select("page_id", "type", F.col("near_pin").alias("pin"), "l.total_ft")
    return rows.groupBy("page_id", "pin").agg(F.count("*").alias("devices"), F.sum("total_ft").alias("cable_ft"), F.count_if(F.col("total_ft") > 120).alias("over"))


Q2 = f"""WITH {POINTS}, pin AS (SELECT s_suppkey % 40 AS page_id, s_suppkey AS pin, (s_suppkey * 389) % 1000 AS px, (s_suppkey * 577) % 1000 AS py FROM supplier),
f AS (SELECT * FROM pt a WHERE event_id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM pt b WHERE b.event_id % 9 = 0 AND a.page_id = b.page_id AND a.type = b.type AND (a.xi - b.xi) ** 2 + (a.yi - b.yi) ** 2 <= 240.25)),
n AS (SELECT page_id, pin, abs(xi - px) + abs(yi - py) AS d FROM f JOIN pin USING (page_id) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY (xi - px) ** 2 + (yi - py) ** 2, pin) = 1),
l AS (SELECT page_id, pin, floor(d * 1.5 / 8 * 10 + 0.5) / 10 + 10 AS ft FROM n) SELECT page_id, pin, count(*) AS devices, floor(sum(ft) * 10 + 0.5) / 10 AS cable_ft, count(*) FILTER (ft > 120) AS over FROM l GROUP BY ALL"""


def q2_rounded(spark, sf):
    return q2(spark, sf).withColumn("cable_ft", S.round_up("cable_ft", 1))


def gap_rows(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = islands.gap_islands(e, ["user_id"], "at", 3600e6, "event_id", name="visit")
    return rows.groupBy("user_id", "visit").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


GAP_ROWS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM g) SELECT user_id, visit::BIGINT AS visit, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM v GROUP BY user_id, visit"""


def stitched(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    runs = o.select((k % 300).alias("page_id"), F.substring("o_orderpriority", 3, 3).alias("s"), F.floor(k / 3000).cast("double").alias("cy"), ((k / 300).cast("long") % 10 * 8.0 + F.when(k % 7 == 0, 5.0).otherwise(0.0)).alias("x0"), ((k / 300).cast("long") % 10 * 8.0 + 7.5).alias("x1"), F.lit(4.0).alias("fs"))
    return islands.stitch(runs, ["page_id"], 0.5, 0.15, 1.0).select("page_id", F.col("line").cast("long").alias("line"), "s", "n")


STITCHED = """WITH r AS (SELECT o_orderkey % 300 AS page_id, substr(o_orderpriority, 3, 3) AS s, o_orderkey // 3000 AS cy, o_orderkey // 300 % 10 * 8.0 + CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END AS x0, o_orderkey // 300 % 10 * 8.0 + 7.5 AS x1 FROM orders),
g AS (SELECT *, x0 - max(x1) OVER (PARTITION BY page_id, cy ORDER BY x0, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, dense_rank() OVER (PARTITION BY page_id ORDER BY cy) - 1 AS line FROM r),
b AS (SELECT *, sum(CASE WHEN gap <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, cy ORDER BY x0, s ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT page_id, line, string_agg(CASE WHEN gap <= 4 AND gap > 0.6 THEN ' ' ELSE '' END || s, '' ORDER BY x0, s) AS s, count(*) AS n FROM b GROUP BY page_id, line, run"""


def polylines(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 8 * 3.0).alias("x"), (F.col("event_id") % 8 * 4.0).alias("y"))
    return islands.polyline(e, ["user_id"]).groupBy("user_id").agg(F.max("run").alias("points"), S.round_up(F.max("run") / 72 * 8, 1).alias("feet"))


POLYLINES = """WITH s AS (SELECT user_id, abs(event_id % 8 - lag(event_id % 8) OVER (PARTITION BY user_id ORDER BY event_id)) * 5.0::DOUBLE AS d FROM events), g AS (SELECT user_id, coalesce(sum(d), 0) AS p FROM s GROUP BY user_id) SELECT user_id, p AS points, floor(p / 72 * 8 * 10 + 0.5) / 10 AS feet FROM g"""


def header_spans(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", F.posexplode(F.split(F.lower("text"), r"\s+")).alias("seq", "str"), (F.col("turn") * 1.0).alias("x"), "turn")
    return islands.span_matches(c, ["conv_id", "turn"], "of the", 3).groupBy("conv_id").agg(F.count("*").alias("hits"), F.min("seq").cast("long").alias("first_at"))


HEADER_SPANS = r"""WITH w AS (SELECT conv_id, turn, string_split_regex(lower(text), '\s+') AS a FROM conversations), p AS (SELECT conv_id, turn, unnest(range(1, len(a))) AS i, a FROM w)
SELECT conv_id, count(*) AS hits, min(i - 1) AS first_at FROM p WHERE a[i] = 'of' AND a[i + 1] = 'the' GROUP BY conv_id"""


def numbering(spark, sf):
    return islands.numbered(t(spark, sf, "supplier").select("s_nationkey", "s_name", "s_acctbal"), ["s_nationkey"], "S", F.desc("s_acctbal"), "s_name").select("s_name", "label")


NUMBERING = "SELECT s_name, 'S' || lpad(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name)::VARCHAR, greatest(2, length((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name))::VARCHAR))::INT, '0') AS label FROM supplier"


def room_components(spark, sf):
    edges = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + F.lit(1 << 40)).alias("b"))
    return graph.components(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def order_chains(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("b"))
    from pyspark.sql import Window

    links = o.withColumn("a", F.lag("b").over(Window.partitionBy("o_custkey").orderBy("b"))).where("a is not null").select("a", "b")
    return graph.chains(links).groupBy("chain").agg(F.count("*").alias("nodes"), F.max("position").cast("long").alias("last_position"))


CHAINS = "SELECT min(o_orderkey) AS chain, count(*) AS nodes, count(*) - 1 AS last_position FROM orders GROUP BY o_custkey HAVING count(*) > 1"


def prototype_match(spark, sf):
    v = t(spark, sf, "embeddings").select("vec_id", "label", *[F.floor(F.element_at("embedding", i + 1) * 1000 + 0.5).cast("double").alias(f"f{i}") for i in range(4)])
    protos = classify.prototypes(v, "label", [f"f{i}" for i in range(4)]).select("label", *[F.floor(F.col(f"f{i}") + 0.5).cast("double").alias(f"f{i}") for i in range(4)])
    return classify.nearest_prototype(v, protos, [f"f{i}" for i in range(4)], "vec_id", "label", 400.0)


PROTOTYPES = """WITH v AS (SELECT vec_id, label, floor(embedding[1]::DOUBLE * 1000 + 0.5) AS a, floor(embedding[2]::DOUBLE * 1000 + 0.5) AS b, floor(embedding[3]::DOUBLE * 1000 + 0.5) AS c, floor(embedding[4]::DOUBLE * 1000 + 0.5) AS d FROM embeddings),
p AS (SELECT label, floor(avg(a) + 0.5) AS a, floor(avg(b) + 0.5) AS b, floor(avg(c) + 0.5) AS c, floor(avg(d) + 0.5) AS d FROM v GROUP BY label),
s AS (SELECT vec_id, p.label, abs(v.a - p.a) + abs(v.b - p.b) + abs(v.c - p.c) + abs(v.d - p.d) AS distance FROM v, p)
SELECT vec_id, CASE WHEN distance <= 400 THEN label::VARCHAR ELSE 'no_match' END AS match, distance FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) = 1"""


def upserted(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return sinks.upsert(s.where("s_suppkey % 3 <> 0"), s.where("s_suppkey % 2 = 0").withColumn("s_nationkey", F.lit(-1)), ["s_suppkey"])


UPSERTED = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0"


def page_replace(spark, sf):
    rows = points(spark, sf, "true").select("page_id", "event_id", F.when(F.col("event_id") % 6 == 0, "manual").otherwise("extracted").alias("source"))
    fresh = rows.where("source = 'extracted' and event_id % 2 = 1")
    return sinks.with_manual(fresh, rows).groupBy("page_id", "source").agg(F.count("*").alias("rows"))


PAGE_REPLACE = f"WITH {POINTS} SELECT page_id, CASE WHEN event_id % 6 = 0 THEN 'manual' ELSE 'extracted' END AS source, count(*) AS rows FROM pt WHERE event_id % 6 = 0 OR event_id % 2 = 1 GROUP BY ALL"


def json_config(spark, sf):
    e = imports.parse_json(t(spark, sf, "events").select("event_id", "props"), "props", "k int")
    return e.groupBy(F.col("props.k").alias("k")).agg(F.count("*").alias("n"))


JSON_CONFIG = "SELECT (props ->> '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1"


def merge_types(spark, sf):
    p = t(spark, sf, "part")
    mapping = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - 1).alias("new"))
    return merge.repoint(t(spark, sf, "lineitem").select("l_partkey", "l_quantity"), mapping, "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


MERGE_TYPES = "SELECT l_partkey - l_partkey % 2 AS l_partkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1"


def first_wins(spark, sf):
    return bom.first_per(t(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("hash")), ["source", "hash"], F.col("doc_id")).select("doc_id", "source")


FIRST_WINS = "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, md5(text)"

PLANS = {
    "symbol_snap": (symbol_snap, SYMBOL_SNAP), "family_attach": (family_attach, FAMILY_ATTACH), "manual_suppression": (manual_suppression, MANUAL), "count_tokens": (count_tokens, COUNT_TOKENS), "pin_assign": (pin_assign, PIN_ASSIGN),
    "exclusion_zones": (exclusion_zones, ZONES), "greedy_dedup": (greedy_dedup, None), "q2_locate_measure": (q2_rounded, Q2), "gap_rows": (gap_rows, GAP_ROWS), "stitched_runs": (stitched, STITCHED), "polyline_lengths": (polylines, POLYLINES), "header_spans": (header_spans, HEADER_SPANS),
    "numbering": (numbering, NUMBERING), "room_components": (room_components, None), "order_chains": (order_chains, CHAINS), "prototype_match": (prototype_match, PROTOTYPES),
    "upsert_rows": (upserted, UPSERTED), "page_replace": (page_replace, PAGE_REPLACE), "json_config": (json_config, JSON_CONFIG), "merge_types": (merge_types, MERGE_TYPES), "first_wins": (first_wins, FIRST_WINS),
}
