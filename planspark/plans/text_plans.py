"""Notes, title blocks and glyph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import glyphs, notes
from .bom_plans import t
from .spatial_plans import POINTS, points

# stand-ins: parts make note wordings; orders are lines of a page (nine or so a page); events are vertices of glyphs (their user)


def note_wordings(spark, sf):
    p = t(spark, sf, "part")
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(
        F.lit("PROVIDE "), F.upper("p_type"), F.lit(" cabinet.  Basis of design is Acme X-"), n, F.lit(" with lock, or approved equal. "), n, F.lit("RU, 48-port, ("), n, F.lit(") cassettes. "),
        F.when(k % 2 == 0, F.concat(n, F.lit("-strand OM4 and 12 strands of OS2 on core-A and Core-B. "))).otherwise(""), F.when(k % 3 == 0, "Outside plant: 24 strand OS2. ").otherwise(""), F.when(k % 5 == 0, "Furnished by owner.").otherwise(""),
    )
    f = notes.note_fields(F.when(k % 7 == 0, "Refer to T-101.").otherwise(text))
    return p.select("p_partkey", f.alias("f")).select("p_partkey", "f.*")


NOTE_WORDINGS = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Refer to T-101' ELSE upper(p_type) || ' cabinet' END AS item, CASE WHEN p_partkey % 7 <> 0 THEN 'Acme X-' || p_size END AS part, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS ru, CASE WHEN p_partkey % 7 <> 0 THEN 48 END AS ports, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS slots,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 2 = 0 THEN p_size + 12 END AS strands_isp, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 = 0 THEN 24 END AS strands_osp, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 2 = 0 THEN 2 END AS cores, p_partkey % 7 <> 0 AND p_partkey % 5 = 0 AS owner_furnished, p_partkey % 7 = 0 AS refer_only FROM part"""

SAYINGS = ["a WAP box", "camera 180", "dd1 suffix is port count", "only N2", "voice only", "a dot", "PTZ dome", "DD3 outlet"]


def described(spark, sf):
    p = t(spark, sf, "part")
    said = F.element_at(F.array(*map(F.lit, SAYINGS)), (F.col("p_partkey") % len(SAYINGS) + 1).cast("int"))
    a = notes.described_anchors(said)
    return p.select("p_partkey", F.array_join(a["primary"], " ").alias("primary_anchors"), F.size(a["associated"]).cast("long").alias("n_associated"), a["port_count"].alias("port_count"), a["notes"].alias("notes"))


DESCRIBED = f"""SELECT p_partkey, ['WAP', '180', 'DD1 DD2 DD3', 'N1 N2 N3 N4 N5', 'DV1 DV2', '', 'PTZ', 'DD1 DD2 DD3'][p_partkey % 8 + 1] AS primary_anchors, [0, 0, 5, 0, 0, 0, 0, 5][p_partkey % 8 + 1] AS n_associated, p_partkey % 8 = 2 AS port_count,
  ['{notes.DESCRIBED[0][3]}', '{notes.DESCRIBED[1][3]}', '{notes.DESCRIBED[3][3]}', '{notes.DESCRIBED[4][3]}', '{notes.DESCRIBED[5][3]}', '{notes.NOT_DESCRIBED}', '', '{notes.DESCRIBED[3][3]}'][p_partkey % 8 + 1] AS notes FROM part"""

TITLES = ["Site fiber overall", "Site telecom routing plan", "Key plan", "Telecom legend", "General notes", "Camera schedules", "Enlarged data rooms", "Rack elevations", "Fiber riser", "Typical details", "First floor plan", "Cover", ""]


def sheet_roles(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    title = F.element_at(F.array(*map(F.lit, TITLES)), (k % len(TITLES) + 1).cast("int"))
    r = notes.sheet_role(title, F.when(k % 2 == 0, "plan").otherwise("rack"), F.when(k % 3 == 0, "high").otherwise("medium"))
    return o.select(k.alias("page_id"), r["role"].alias("role"), r["confidence"].alias("confidence"), r["via"].alias("via"))


SHEET_ROLES = """WITH p AS (SELECT o_orderkey AS k, ['osp_overview', 'osp_route', 'key_plan', 'legend', 'notes', 'schedule', 'tr_room', 'rack', 'riser', 'detail', 'plan', NULL, NULL][o_orderkey % 13 + 1] AS r FROM orders)
SELECT k AS page_id, coalesce(r, CASE WHEN k % 2 = 0 THEN 'plan' END) AS role, CASE WHEN r IS NOT NULL THEN 'high' WHEN k % 6 = 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN r IS NOT NULL THEN 'title' WHEN k % 2 = 0 THEN 'classifier' ELSE 'none' END AS via FROM p"""


def title_items(spark, sf):
    """Eight items a page: labels, values under them, and a number in the corner."""
    o = t(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 8
    page = F.floor(k / 8)
    text = F.element_at(F.array(F.when(page % 3 != 0, "Sheet Number").otherwise("other"), F.concat(F.lit("T1."), (page % 90).cast("string")), F.lit("Drawing title"), F.lit("FIRST FLOOR"), F.lit("PLAN"), F.lit("Building No."), (page % 300).cast("string"), F.lit("E-77")), (n + 1).cast("int"))
    x = F.element_at(F.array(*[F.lit(v) for v in (0.5, 0.52, 0.2, 0.21, 0.22, 0.1, 0.11, 0.9)]), (n + 1).cast("int"))
    y = F.element_at(F.array(*[F.lit(v) for v in (0.5, 0.53, 0.2, 0.21, 0.22, 0.7, 0.71, 0.95)]), (n + 1).cast("int"))
    h = F.when(n.isin(0, 2, 5), 1.0).otherwise(2.0)
    return o.select(page.alias("page_id"), k.alias("seq"), text.alias("s"), x.alias("x"), y.alias("y"), h.alias("h"))


def title_blocks(spark, sf):
    return notes.title_blocks(title_items(spark, sf))


TITLE_BLOCKS = """WITH p AS (SELECT o_orderkey // 8 AS p, list(o_orderkey % 8) AS h FROM orders GROUP BY 1), v AS (SELECT p, p % 3 <> 0 AND list_contains(h, 0) AND list_contains(h, 1) AS lab, list_contains(h, 7) AS cor, list_contains(h, 2) AS tl, list_contains(h, 3) AS a, list_contains(h, 4) AS b, list_contains(h, 5) AND list_contains(h, 6) AS bu FROM p)
SELECT p AS page_id, CASE WHEN lab THEN 'T1.' || p % 90 WHEN cor THEN 'E-77' END AS sheet_number, CASE WHEN lab THEN 'label' WHEN cor THEN 'position' END AS number_via, CASE WHEN tl AND (a OR b) THEN concat_ws(' ', CASE WHEN a THEN 'FIRST FLOOR' END, CASE WHEN b THEN 'PLAN' END) END AS title, CASE WHEN bu THEN (p % 300)::VARCHAR END AS building_label FROM v"""


def drawing_notes(spark, sf):
    o = t(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 6
    text = F.element_at(F.array(F.lit("DRAWING NOTES"), F.concat(F.lit("1. PROVIDE "), F.col("o_orderpriority")), F.lit("2. SEE"), F.lit("sheet T-1"), F.lit("GENERAL NOTES:"), F.lit("3. NOT THIS")), (n + 1).cast("int"))
    return notes.drawing_notes(o.select(F.floor(k / 6).alias("page_id"), k.alias("seq"), text.alias("str"), F.lit(0.3).alias("x"), (0.1 + n * 0.02).alias("y"), F.lit(0.2).alias("left")))


DRAWING_NOTES = """WITH o AS (SELECT o_orderkey // 6 AS p, o_orderkey % 6 AS n, o_orderpriority AS pr FROM orders), t AS (SELECT p, max(pr) FILTER (n = 1) AS pr, bool_or(n = 0) AS title, bool_or(n = 2) AS two, bool_or(n = 3) AS more, bool_or(n = 4) AS stop, bool_or(n = 5) AS three FROM o GROUP BY p)
SELECT p AS page_id, 1 AS ref, 'PROVIDE ' || pr AS note FROM t WHERE title AND pr IS NOT NULL UNION ALL SELECT p, 2, 'SEE' || CASE WHEN more THEN ' sheet T-1' ELSE '' END FROM t WHERE title AND two"""


def allowance_lines(spark, sf):
    o = t(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 6
    text = F.element_at(F.array(F.concat(F.lit("• Provide ("), (F.col("o_custkey") % 30 + 1).cast("string"), F.lit(") new cameras.")), F.lit("• 150'-6\" cable to each new camera"), F.lit("• provide a new"), F.lit("mount for each camera"), F.lit("- patch cords"), F.lit("* too far")), (n + 1).cast("int"))
    lines = o.select(F.floor(k / 6).alias("group"), F.lit("Camera riser diagram").alias("system"), k.alias("seq"), (n * 0.01 + F.when(n == 5, 0.1).otherwise(0.0)).alias("y"), text.alias("str"))
    whole = lines.groupBy("group").agg(F.count("*").alias("n")).where("n = 6").select("group")
    return notes.allowances(lines.join(whole, "group"))


ALLOWANCES = """WITH o AS (SELECT o_orderkey // 6 AS g, o_orderkey % 6 AS n, o_custkey % 30 + 1 AS c FROM orders), u AS (SELECT g, max(c) FILTER (n = 0) AS c, count(*) AS k FROM o GROUP BY g HAVING count(*) = 6),
r AS (SELECT unnest([1, 2, 3, 4]) AS n)
SELECT g AS group, 'CAMERA-RISER-DIAGRAM-' || n AS key, ['Provide (' || c || ') new cameras.', '150''-6" cable to each new camera', 'provide a new mount for each camera', 'patch cords'][n] AS item, [1.0, 150.5, 1.0, NULL][n]::DOUBLE AS per_unit_qty, ['ea', 'ft', 'ea', NULL][n] AS unit, CASE WHEN n < 4 THEN c END AS unit_count, [NULL, 'per camera', 'per camera', NULL][n] AS per_text FROM u, r"""


def page_lines(spark, sf):
    o = t(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 8
    runs = o.select(F.floor(k / 8).alias("page_id"), k.alias("seq"), F.concat(F.lit("w"), n.cast("string")).alias("s"), (F.floor(n / 2) * 11.0 + F.when(n >= 6, 40.0).otherwise(0.0)).alias("x0"), (F.floor(n / 2) * 11.0 + F.when(n >= 6, 40.0).otherwise(0.0) + 9).alias("x1"), (n % 2 * 20.0).alias("y"), F.lit(10.0).alias("size"))
    return notes.page_lines(runs).select("page_id", "str", "left", "right")


PAGE_LINES = """WITH o AS (SELECT o_orderkey // 8 AS p, o_orderkey % 8 AS n FROM orders), b AS (SELECT p, count(*) AS c FROM o GROUP BY p)
SELECT o.p AS page_id, string_agg('w' || n, ' ' ORDER BY n) AS str, min(n // 2 * 11 + CASE WHEN n >= 6 THEN 40 ELSE 0 END)::DOUBLE AS left, max(n // 2 * 11 + CASE WHEN n >= 6 THEN 40 ELSE 0 END + 9)::DOUBLE AS right FROM o GROUP BY o.p, n % 2, n >= 6"""


def glyph_vertices(spark, sf):
    e = t(spark, sf, "events")
    k = F.col("event_id")
    return e.select("user_id", (k % 5).alias("part"), F.lit(True).alias("closed"), (k % 2 == 0).alias("filled"), k.alias("seq"), (k * 7919 % 1000).cast("double").alias("x"), (k * 104729 % 1000).cast("double").alias("y"))


def glyph_aspects(spark, sf):
    return glyphs.long_over_wide(glyph_vertices(spark, sf), ["user_id"]).select("user_id", F.floor(F.col("aspect") * 1000 + 0.5).cast("long").alias("aspect"))


GLYPH_ASPECTS = """WITH v AS (SELECT user_id, (event_id * 7919 % 1000)::DOUBLE AS x, (event_id * 104729 % 1000)::DOUBLE AS y FROM events), s AS (SELECT user_id, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM v GROUP BY 1),
r AS (SELECT user_id, (xx + yy) / 2 AS h, sqrt(greatest(0, ((xx + yy) / 2) ** 2 - (xx * yy - xy * xy))) AS q FROM s) SELECT user_id, floor(CASE WHEN h + q > 0 AND h - q > 0 THEN sqrt((h + q) / (h - q)) ELSE 1 END * 1000 + 0.5)::BIGINT AS aspect FROM r"""


def glyph_lenses(spark, sf):
    sig = glyphs.signatures(glyph_vertices(spark, sf), ["user_id"]).withColumn("match", F.when(F.col("user_id") % 9 == 0, "cam"))
    tokens = t(spark, sf, "region").select(F.concat((F.col("r_regionkey") % 5).cast("string"), F.lit("-lens")).alias("lens"), F.col("r_name").alias("token"))
    return glyphs.named_lenses(sig, tokens).groupBy("type", "confidence", "flag", "via").agg(F.count("*").alias("glyphs"))


def distance_clusters(spark, sf):
    items = t(spark, sf, "events").select("user_id", F.col("event_id").alias("item"), (F.col("event_id") % 211).cast("double").alias("d"))
    got = glyphs.distance_clusters(items, ["user_id"], 12.0)
    return got.where("cluster = 1").groupBy("user_id").agg(F.count("*").alias("largest"), F.min("d").alias("nearest"))


DISTANCE_CLUSTERS = """WITH i AS (SELECT user_id, event_id, (event_id % 211)::DOUBLE AS d FROM events), g AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY user_id ORDER BY d, event_id) > 12 THEN 1 ELSE 0 END AS n FROM i), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY d, event_id) AS run FROM g)
SELECT user_id, largest, nearest FROM (SELECT user_id, run, count(*) AS largest, min(d) AS nearest FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY largest DESC, run) = 1"""


def grouped_parts(spark, sf):
    p = points(spark, sf, "true").select("page_id", F.col("event_id").alias("part"), F.when(F.col("event_id") % 20 == 0, 1.0).otherwise(0.0).alias("area"), F.array(F.struct("x", "y"), F.struct((F.col("x") + 3).alias("x"), "y")).alias("points"))
    return glyphs.grouped_parts(p, 0.5).groupBy("page_id", "body").agg(F.count("*").alias("members"))


GROUPED_PARTS = f"""WITH {POINTS}, b AS (SELECT page_id, event_id AS body, xi + 1.5 AS cx, yi AS cy FROM pt WHERE event_id % 20 = 0),
n AS (SELECT page_id, event_id, arg_min(body, (least(sqrt((xi - cx) ** 2 + (yi - cy) ** 2), sqrt((xi + 3 - cx) ** 2 + (yi - cy) ** 2)), body)) AS body FROM pt JOIN b USING (page_id) WHERE event_id % 20 <> 0 GROUP BY ALL)
SELECT page_id, body, count(*) AS members FROM (SELECT page_id, body FROM b UNION ALL SELECT page_id, body FROM n) GROUP BY ALL"""

PLANS = {
    "note_wordings": (note_wordings, NOTE_WORDINGS), "described_anchors": (described, DESCRIBED), "sheet_roles": (sheet_roles, SHEET_ROLES), "title_blocks": (title_blocks, TITLE_BLOCKS), "drawing_notes": (drawing_notes, DRAWING_NOTES), "allowance_lines": (allowance_lines, ALLOWANCES), "page_lines": (page_lines, PAGE_LINES),
    "glyph_aspects": (glyph_aspects, GLYPH_ASPECTS), "glyph_lenses": (glyph_lenses, None), "distance_clusters": (distance_clusters, DISTANCE_CLUSTERS), "grouped_parts": (grouped_parts, GROUPED_PARTS),
}
