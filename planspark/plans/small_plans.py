"""Frames, guards, readers and small column rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import frames, geometry, graph, islands, merge, osp, readers, reconcile
from ..operators.spatial import point_to_segment
from ..sources import imports
from .bom_plans import t
from .device_plans import SEGMENTS, evidence
from .spatial_plans import POINTS, points


def content_places(spark, sf):
    p = points(spark, sf, "true").select("page_id", "event_id", "x", "y")
    return islands.normalise(p, ["page_id"]).select("event_id", "cx_norm", "cy_norm")


CONTENT_PLACES = f"""WITH {POINTS}, b AS (SELECT page_id, min(xi) AS x0, max(xi) AS x1, min(yi) AS y0, max(yi) AS y1 FROM pt GROUP BY 1)
SELECT event_id, floor((xi - x0)::DOUBLE / greatest(x1 - x0, 1e-9) * 1e4 + 0.5) / 1e4 AS cx_norm, floor((y1 - yi)::DOUBLE / greatest(y1 - y0, 1e-9) * 1e4 + 0.5) / 1e4 AS cy_norm FROM pt JOIN b USING (page_id)"""


def run_words(spark, sf):
    runs = t(spark, sf, "part").select("p_partkey", F.lit(1).alias("seq"), F.concat_ws(" ", "p_brand", "p_type").alias("str"), F.lit(10.0).alias("x"), (F.length(F.concat_ws(" ", "p_brand", "p_type")) * 2.0).alias("width"))
    return imports.words(runs, ["p_partkey"]).select("p_partkey", F.col("at").cast("long").alias("place"), "word", "x0")


RUN_WORDS = r"""WITH w AS (SELECT p_partkey, string_split(p_brand || ' ' || p_type, ' ') AS a FROM part), u AS (SELECT p_partkey, unnest(a) AS word, generate_subscripts(a, 1) - 1 AS place, a FROM w)
SELECT p_partkey, place, word, 10.0 + 2.0 * (length(array_to_string(a[1:place], ' ')) + CASE WHEN place > 0 THEN 1 ELSE 0 END)::DOUBLE AS x0 FROM u"""


def page_shapes(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders")
    strip = frames.strip_place(k % 100 / 100.0, k % 64 / 64.0, F.lit(0.25), F.lit(0.75), F.when(k % 3 == 0, 0.125), F.when(k % 5 == 0, 0.5))
    kind = frames.sheet_class(k % 400, F.when(k % 3 != 0, k % 100), k % 3000)
    old = frames.legacy_length(k % 64 / 64.0, k % 32 / 32.0, F.lit(0.5), F.lit(0.25), F.lit(1200.0), F.lit(900.0), F.when(k % 7 != 0, 0.125).otherwise(0.0), F.lit(1.0))
    colour = frames.unit_colour(F.array(k % 256, F.lit(51), F.lit(255)))
    return o.select(k.alias("k"), strip["x"].alias("sx"), strip["y"].alias("sy"), kind["vector_text"].alias("text"), kind["vector_geometry"].alias("geometry"), kind["raster_only"].alias("raster"), old["ft"].alias("old_ft"), frames.bridge_tolerance(F.when(k % 4 != 0, k % 9 * 1.0), F.when(k % 11 == 0, 3.0)).alias("bridge"), frames.usable_scale(F.when(k % 2 == 0, 9.0), F.when(k % 3 == 0, 0.125), F.lit(1.0)).alias("scaled"), frames.limit_ft(F.when(k % 2 == 0, (k % 300).cast("string"))).alias("limit_ft"), S.round_up(colour[0], 6).alias("red"), S.round_even(k % 1000 / 8.0, 1).alias("even"), S.missing_as(F.when(k % 3 == 0, k % 2 * 1.0), 7.0).alias("given"))


PAGE_SHAPES = """SELECT o_orderkey AS k, floor((CASE WHEN o_orderkey % 3 = 0 THEN 0.125 ELSE 0 END + o_orderkey % 100 / 100.0::DOUBLE * CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 1 END) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS sx, floor((0.25 + o_orderkey % 64 / 64.0::DOUBLE * 0.5) * 1000 + 0.5) / 1000 AS sy,
  o_orderkey % 400 >= 200 AS text, (o_orderkey % 3 <> 0 AND o_orderkey % 100 >= 50) OR o_orderkey % 3000 >= 2000 AS geometry, NOT (o_orderkey % 400 >= 200) AND NOT ((o_orderkey % 3 <> 0 AND o_orderkey % 100 >= 50) OR o_orderkey % 3000 >= 2000) AS raster,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(sqrt(((o_orderkey % 64 / 64.0::DOUBLE - 0.5) * 1200) ** 2 + ((o_orderkey % 32 / 32.0::DOUBLE - 0.25) * 900) ** 2) * 1.40 / 150 * 8 + 0.5) END AS old_ft,
  CASE WHEN o_orderkey % 11 = 0 THEN 3 WHEN o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0 THEN greatest(2, least(14, 2.5 * (o_orderkey % 9))) ELSE 6 END::DOUBLE AS bridge, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS scaled, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 300 ELSE 295 END::DOUBLE AS limit_ft,
  floor(o_orderkey % 256 / 255.0::DOUBLE * 1e6 + 0.5) / 1e6 AS red, round_even(o_orderkey % 1000 / 8.0, 1)::DOUBLE AS even, CASE WHEN o_orderkey % 6 = 3 THEN 1 ELSE 7 END::DOUBLE AS given FROM orders"""


def fitted_lines(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 90 * 1.0).alias("x"), (F.col("event_id") % 90 * 2.0 + F.col("event_id") % 2 * 0.5).alias("y"))
    return geometry.lines(e, ["user_id"], 0.2).select("user_id", "n", S.round_up("length", 2).alias("length"))


FITTED_LINES = """WITH v AS (SELECT user_id, (event_id % 90)::DOUBLE AS x, event_id % 90 * 2 + event_id % 2 * 0.5::DOUBLE AS y FROM events), c AS (SELECT user_id, avg(x) AS cx, avg(y) AS cy, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS th, count(*) AS n FROM v GROUP BY 1),
t AS (SELECT user_id, n, (x - cx) * cos(th) + (y - cy) * sin(th) AS a, abs((y - cy) * cos(th) - (x - cx) * sin(th)) AS off FROM v JOIN c USING (user_id)), g AS (SELECT user_id, any_value(n) AS n, max(a) - min(a) AS length, max(off) AS off FROM t GROUP BY 1)
SELECT user_id, n, floor(length * 100 + 0.5) / 100 AS length FROM g WHERE n >= 4 AND length > 0 AND off / length <= 0.2"""


def distances(spark, sf):
    k = F.col("o_orderkey")
    c = {"x": k % 100 * 1.0, "y": k % 70 * 1.0, "ax": k % 13 * 1.0, "ay": k % 17 * 1.0, "bx": k % 19 * 3.0, "by": k % 23 * 3.0}
    far = point_to_segment(*c.values())
    hit = frames.segment_hits(c["ax"], c["ay"], c["bx"], c["by"], F.lit(10.0), F.lit(10.0), F.lit(30.0), F.lit(30.0))
    rows = t(spark, sf, "orders").select(k.alias("k"), S.round_up(far, 4).alias("far"), hit.alias("hit"), F.array(k % 7 * 10.0, F.lit(0.0), F.when(k % 5 != 0, 5.0)).alias("rgb"))
    return rows.join(geometry.by_colour(rows, [30.0, 0.0, 0.0], 12.0, "rgb").select("k", F.lit(True).alias("near_red")), "k", "left").select("k", "far", "hit", F.coalesce("near_red", F.lit(False)).alias("near_red"))


DISTANCES = """WITH p AS (SELECT o_orderkey AS k, (o_orderkey % 100)::DOUBLE AS x, (o_orderkey % 70)::DOUBLE AS y, (o_orderkey % 13)::DOUBLE AS ax, (o_orderkey % 17)::DOUBLE AS ay, o_orderkey % 19 * 3.0::DOUBLE AS bx, o_orderkey % 23 * 3.0::DOUBLE AS byy FROM orders),
l AS (SELECT *, (bx - ax) ** 2 + (byy - ay) ** 2 AS l2 FROM p), t AS (SELECT *, CASE WHEN l2 = 0 THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (byy - ay)) / l2)) END AS t FROM l)
SELECT k, floor(sqrt((x - (ax + t * (bx - ax))) ** 2 + (y - (ay + t * (byy - ay))) ** 2) * 10000 + 0.5) / 10000 AS far, len(list_filter(range(7), lambda s: ax + (bx - ax) * s / 6 BETWEEN 10 AND 30 AND ay + (byy - ay) * s / 6 BETWEEN 10 AND 30)) > 0 AS hit, abs(k % 7 * 10 - 30) <= 12 AND k % 5 <> 0 AS near_red FROM t"""


def printed_schedule(spark, sf):
    o = t(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 10
    page = F.floor(k / 10)
    cell = lambda text, x, d: F.struct(text.cast("string").alias("str"), F.lit(x).alias("x"), (0.1 + n * 0.05).alias("y"), (k * 4 + d).alias("seq"))
    items = o.select(page.alias("page_id"), F.explode(F.array(cell(F.when(n == 3, "note").otherwise(F.concat(F.lit("U-"), k.cast("string"))), 0.11, 0), cell(F.lit("to"), 0.52, 1), cell(F.col("o_custkey"), 0.49, 2))).alias("i")).select("page_id", "i.*")
    heads = o.select(page.alias("page_id")).distinct().select("page_id", F.explode(F.array(F.struct(F.lit("uin").alias("column"), F.lit(0.1).alias("hx")), F.struct(F.lit("cable").alias("column"), F.lit(0.5).alias("hx")))).alias("h")).select("page_id", "h.column", "h.hx", F.lit(0.05).alias("hy"))
    got = readers.read_schedule(items, heads, 0.01, "^U-[0-9]+$")
    return got.select("page_id", "uin", F.col("cells")["cable"].alias("cable"))


PRINTED_SCHEDULE = "SELECT o_orderkey // 10 AS page_id, 'U-' || o_orderkey AS uin, o_custkey || ' to' AS cable FROM orders WHERE o_orderkey % 10 <> 3"


def coded_legend(spark, sf):
    o = t(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 5
    page = F.floor(k / 5)
    mark = F.struct((n + 1).cast("string").alias("str"), F.lit(0.1).alias("x"), (0.1 + n * 0.05).alias("y"), (k * 2).alias("seq"))
    text = F.struct(F.col("o_orderpriority").alias("str"), F.lit(0.2).alias("x"), (0.1 + n * 0.05).alias("y"), (k * 2 + 1).alias("seq"))
    whole = o.groupBy(page.alias("page_id")).agg(F.count("*").alias("n")).where("n = 5").select("page_id")
    items = o.select(page.alias("page_id"), F.explode(F.array(mark, text)).alias("i")).select("page_id", "i.*").join(whole, "page_id")
    return readers.coded_notes(items, 0.01).select("page_id", F.col("number").cast("long").alias("number"), "text")


CODED_LEGEND = "SELECT o_orderkey // 5 AS page_id, o_orderkey % 5 + 1 AS number, o_orderpriority AS text FROM orders WHERE o_orderkey // 5 IN (SELECT o_orderkey // 5 FROM orders GROUP BY 1 HAVING count(*) = 5)"

LINES = ["FIRST FLOOR PLAN", "camera schedule", "RISER DIAGRAM", "general text of no role", "TYPICAL DETAIL", "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE PLAN"]


def titles(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    return readers.title_phrases(o.select((F.col("o_custkey") % 500).alias("page_id"), F.element_at(F.array(*map(F.lit, LINES)), (k % 6 + 1).cast("int")).alias("line")))


TITLES = f"SELECT DISTINCT o_custkey % 500 AS page_id, {LINES}[o_orderkey % 6 + 1] AS phrase FROM orders WHERE o_orderkey % 6 IN (0, 2, 4)"


def drawing_scales(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    label = F.concat(F.lit("SCALE: "), F.when(k % 3 == 0, "1/8").when(k % 3 == 1, "1/4").otherwise("1/8"), F.lit('" = 1\'-0" and '), F.when(k % 2 == 0, '1/4" = 1\'-0"').otherwise("no scale"))
    return readers.sheet_scale(o.select(k.alias("page_id"), label.alias("text"))).select("page_id", "ft_per_inch", "count")


DRAWING_SCALES = """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 1 THEN 4 ELSE 8 END::DOUBLE AS ft_per_inch, CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS count FROM orders"""


def page_references(spark, sf):
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    text = F.concat(F.lit("patch  panels in tr "), F.when(k % 3 == 0, "located").otherwise(F.concat(F.lit("h"), k.cast("string"), F.lit("-1"))), F.lit(" see T-0"), (k % 90 + 10).cast("string"), F.lit(" GENERAL AND PHASING"))
    return p.select("p_partkey", S.room_reference(text).alias("room"), F.array_join(S.phasing_sheets(text), ",").alias("sheets"), S.strands_per_core(F.concat(F.lit("("), k.cast("string"), F.lit(") 12 strand os2 and 6-strands OM4"))).alias("strands"))


PAGE_REFERENCES = "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'H' || p_partkey || '-1' END AS room, 'T-0' || (p_partkey % 90 + 10) AS sheets, 18 AS strands FROM part"


def main_callouts(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("seq"), F.floor("l_quantity").cast("long").alias("cables"))
    return osp.primary_callout(li)


MAIN_CALLOUTS = "SELECT l_orderkey AS segment, l_linenumber AS seq, floor(l_quantity)::BIGINT AS cables FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity) DESC, l_linenumber) = 1"


def leader_marks(spark, sf):
    schedule, labels, _ = evidence(spark, sf)
    devices = reconcile.placed_by_label(schedule, labels)
    leaders = labels.where("seq % 50 = 0").select("page_id", F.col("seq").alias("leader"), "type", "x", "y", (F.col("seq") % 3 + 1).alias("quantity"))
    got = reconcile.leader_groups(devices, leaders)
    return got.groupBy("page_id", "xy_source").agg(F.count("*").alias("devices"))


def library_links(spark, sf):
    own = t(spark, sf, "part").select(F.col("p_partkey").alias("type_id"), F.col("p_size").alias("legend"))
    library = t(spark, sf, "part").groupBy(F.col("p_size").alias("legend")).agg(F.min("p_partkey").alias("new"))
    mapping = own.join(library, "legend").select(F.col("type_id").alias("old"), "new")
    return merge.repoint(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("type_id")), mapping, "type_id").groupBy("type_id").agg(F.count("*").alias("n"))


LIBRARY_LINKS = "WITH m AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size) AS new FROM part) SELECT coalesce(new, l_partkey) AS type_id, count(*) AS n FROM lineitem LEFT JOIN m ON p_partkey = l_partkey GROUP BY 1"


def counted_types(spark, sf):
    m = t(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("page_id"), F.concat(F.lit("T"), (F.col("s_nationkey") % 5).cast("string")).alias("type"), (F.col("s_suppkey") % 6).alias("quantity"))
    aliases = t(spark, sf, "region").select(F.concat(F.lit("T"), (F.col("r_regionkey") % 3).cast("string")).alias("type"), F.lit("camera").alias("alias")).distinct()
    return frames.expand_counts(m, aliases).groupBy("page_id", "type").agg(F.count("*").alias("n"))


COUNTED_TYPES = "SELECT s_suppkey % 40 AS page_id, CASE WHEN s_nationkey % 5 < 3 THEN 'camera' ELSE 'T' || s_nationkey % 5 END AS type, sum(s_suppkey % 6)::BIGINT AS n FROM supplier WHERE s_suppkey % 6 > 0 GROUP BY ALL"


def model_totals(spark, sf):
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    rooms = c.select(k.alias("tr_name"), F.when(k % 3 != 0, k % 4).alias("racks"))
    sized = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("rule_key"), F.col("o_custkey").alias("tr_name"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 9 * 1.0).alias("qty"))
    racks = frames.rack_totals(sized, rooms).select(F.concat(F.lit("rack "), "rule_key").alias("key"), F.col("qty").cast("double").alias("qty"), F.col("missing").alias("other"))
    cells = t(spark, sf, "orders").select(F.col("o_custkey").alias("tr_name"), F.when(F.col("o_orderkey") % 5 == 0, "wall_mount").otherwise(F.col("o_orderstatus")).alias("category"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 7 * 0.5).alias("quantity"))
    items = frames.room_items(cells).select(F.concat(F.lit("room "), "category").alias("key"), F.col("qty").cast("double").alias("qty"), F.col("rooms").alias("other"))
    counts = t(spark, sf, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("devices"))
    ports = t(spark, sf, "region").select(F.when(F.col("r_regionkey") == 0, "click").otherwise("view").alias("type"), F.lit(2).cast("long").alias("ports")).distinct()
    floor = frames.floor_assemblies(counts, ports).select(F.concat(F.lit("floor "), "type").alias("key"), F.col("faceplates").cast("double").alias("qty"), F.col("jacks").alias("other"))
    return racks.unionByName(items).unionByName(floor)


MODEL_TOTALS = """WITH r AS (SELECT o_orderpriority AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 END AS q, o_custkey % 3 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS racked FROM orders)
SELECT 'rack ' || k AS key, floor(sum(coalesce(q, 0)) * 10 + 0.5)::DOUBLE / 10 AS qty, count(*) FILTER (racked AND q IS NULL) AS other FROM r GROUP BY k
UNION ALL SELECT 'room ' || o_orderstatus, floor(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 * 0.5 ELSE 0 END) * 10 + 0.5)::DOUBLE / 10, count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_orderstatus
UNION ALL SELECT 'floor ' || event_type, count(*)::DOUBLE, CASE WHEN event_type IN ('click', 'view') THEN count(*) * 2 END FROM events GROUP BY event_type"""


def region_members(spark, sf):
    n = F.col("n_nationkey")
    regions = t(spark, sf, "nation").select((n % 30).cast("long").alias("page_id"), (n * 30.0).alias("x0"), F.lit(100.0).alias("y0"), (n * 30 + 400.0).alias("x1"), F.lit(800.0).alias("y1"))
    got = frames.in_any_region(points(spark, sf, "true").select("page_id", F.col("event_id").alias("device"), "x", "y"), regions)
    return got.groupBy("page_id").agg(F.count_if("in_region").alias("inside"))


REGION_MEMBERS = f"""WITH {POINTS} SELECT page_id, count(*) FILTER (page_id >= 25 OR (xi BETWEEN page_id * 30 AND page_id * 30 + 400 AND yi BETWEEN 100 AND 800)) AS inside FROM pt GROUP BY page_id"""


def waypoint_ways(spark, sf):
    s = F.col("s_suppkey")
    waypoints = t(spark, sf, "supplier").select((s % 40).alias("page_id"), s.alias("waypoint"), (s * 389 % 1000).cast("double").alias("wx"), (s * 577 % 1000).cast("double").alias("wy"))
    starts = points(spark, sf, "true").select("page_id", F.col("event_id").alias("device"), "x", "y", F.lit(500.0).alias("tx"), F.lit(500.0).alias("ty"))
    return graph.waypoint_paths(starts, waypoints).groupBy("hop").agg(F.count("*").alias("devices"))


WAYPOINT_WAYS = f"""WITH RECURSIVE {POINTS}, w AS (SELECT s_suppkey % 40 AS page_id, s_suppkey AS waypoint, s_suppkey * 389 % 1000 AS wx, s_suppkey * 577 % 1000 AS wy FROM supplier),
r AS (SELECT page_id, event_id, 0 AS hop, xi AS x, yi AS y FROM pt UNION ALL
  SELECT page_id, event_id, hop, x, y FROM (SELECT r.page_id, event_id, hop + 1 AS hop, wx AS x, wy AS y, row_number() OVER (PARTITION BY event_id ORDER BY (wx - x) ** 2 + (wy - y) ** 2, waypoint) AS n FROM r JOIN w USING (page_id) WHERE (wx - 500) ** 2 + (wy - 500) ** 2 < (x - 500) ** 2 + (y - 500) ** 2) WHERE n = 1)
SELECT hop, count(*) AS devices FROM r WHERE hop > 0 GROUP BY hop"""


def segment_lengths(spark, sf):
    """Old and new lengths by sheet: what limits the rules of the project give."""
    from .device_plans import segments

    return segments(spark, sf).groupBy("sheet").agg(F.count_if(F.col("total_ft") > 295).alias("over"), F.sum("total_ft").alias("ft"))


SEGMENT_LENGTHS = f"WITH {SEGMENTS} SELECT sheet, count(*) FILTER (ft > 295) AS over, sum(ft) AS ft FROM s GROUP BY sheet"

PLANS = {
    "content_places": (content_places, CONTENT_PLACES), "run_words": (run_words, RUN_WORDS), "page_shapes": (page_shapes, PAGE_SHAPES), "fitted_lines": (fitted_lines, FITTED_LINES), "segment_distances": (distances, DISTANCES), "printed_schedule": (printed_schedule, PRINTED_SCHEDULE), "coded_legend": (coded_legend, CODED_LEGEND),
    "title_phrases": (titles, TITLES), "drawing_scales": (drawing_scales, DRAWING_SCALES), "page_references": (page_references, PAGE_REFERENCES), "main_callouts": (main_callouts, MAIN_CALLOUTS), "leader_marks": (leader_marks, None), "library_links": (library_links, LIBRARY_LINKS), "counted_types": (counted_types, COUNTED_TYPES),
    "model_totals": (model_totals, MODEL_TOTALS), "region_members": (region_members, REGION_MEMBERS), "waypoint_ways": (waypoint_ways, WAYPOINT_WAYS), "segment_lengths": (segment_lengths, SEGMENT_LENGTHS),
}
