"""Schedule reading, sheet kinds and text detection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, detect, tables
from .bom_plans import t
from .spatial_plans import POINTS, points

# stand-ins: nine orders are a room schedule on a page of its own, under a title and a header row


def schedule_items(spark, sf):
    o = t(spark, sf, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 9
    page = F.floor(k / 9)

    def put(text, x, y, seq):
        return F.struct(text.cast("string").alias("str"), F.lit(float(x)).alias("x"), (y if not isinstance(y, float) else F.lit(y)).alias("y"), seq.cast("long").alias("seq"))

    heads = [("Room Schedule", 0.5, 0.05), ("TR", 0.1, 0.07), ("TERMINATIONS", 0.3, 0.07), ("MIN PATCH", 0.5, 0.07), ("PANELS", 0.5, 0.075), ("BUILDING", 0.7, 0.07), ("LEVEL", 0.9, 0.07), ("GENERAL", 0.5, 0.9)]
    top = o.select(page.alias("page_id")).distinct().select("page_id", F.explode(F.array(*[put(F.lit(s), x, y, F.lit(i)) for i, (s, x, y) in enumerate(heads)])).alias("i"))
    y = 0.2 + n * 0.02
    cells = F.array(
        put(F.concat(F.lit(" r"), k.cast("string")), 0.11, y, k * 10), put(F.when(n == 7, "n/a").otherwise(F.format_string("%,d", F.col("o_custkey"))), 0.31, y, k * 10 + 1), put(k % 7, 0.52, y, k * 10 + 2),
        put(F.concat(F.lit("B"), (k % 5).cast("string")), 0.69, y, k * 10 + 3), put(k % 4, 0.88, y, k * 10 + 4),
    )
    rows = o.select(page.alias("page_id"), F.explode(F.slice(cells, 1, F.when(n == 8, 4).otherwise(5))).alias("i"))
    return top.unionByName(rows).select("page_id", "i.*")


def q8(spark, sf):
    return tables.schedule_rows(schedule_items(spark, sf))


Q8 = """SELECT o_orderkey // 9 AS page_id, 'R' || o_orderkey AS tr_number, 'B' || o_orderkey % 5 AS building, (o_orderkey % 4)::VARCHAR AS level, o_custkey AS terminations, o_orderkey % 7 AS patch_panels FROM orders WHERE o_orderkey % 9 < 7"""


def table_candidates(spark, sf):
    got = tables.candidates(schedule_items(spark, sf))
    return got.select("page_id", "title", "archetype", F.array_join("headers", "|").alias("headers"))


TABLE_CANDIDATES = "SELECT DISTINCT o_orderkey // 9 AS page_id, 'ROOM SCHEDULE' AS title, 'tr_summary' AS archetype, 'TR|TERMINATIONS|MIN PATCH PANELS|BUILDING|LEVEL' AS headers FROM orders"


def mean_columns(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 37 * 10.0).alias("x"), F.lit(0.0).alias("y"), F.col("event_type").alias("str"))
    return tables.mean_columns(e, ["user_id"], 4.0).groupBy("user_id").agg(F.count_distinct("column").alias("columns"), F.count("*").alias("items"), F.max("cx").alias("last"))


MEAN_COLUMNS = "SELECT user_id, count(DISTINCT event_id % 37) AS columns, count(*) AS items, max(event_id % 37 * 10.0)::DOUBLE AS last FROM events GROUP BY user_id"


def text_items(spark, sf):
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "W ").when(k % 4 == 1, F.concat(F.lit("FP"), (k % 7).cast("string"))).when(k % 4 == 2, F.concat(F.lit("dv"), (k % 3).cast("string"))).otherwise("fp")
    return points(spark, sf, "true").select("page_id", k.alias("seq"), text.alias("str"), "x", "y")


def types(spark, sf):
    n = t(spark, sf, "nation")
    k = F.col("n_nationkey")
    config = F.when(k == 0, '{"anchor": "w", "families": ["DV"], "fam_radius": 60}').when(k == 1, '{"anchor": "FP", "anchor_mode": "regex", "uin_pattern": "^FP[0-9]+$"}').when(k % 2 == 0, "{}")
    return detect.type_catalog(n.select(k.cast("long").alias("type_id"), F.col("n_name").alias("name"), config.alias("detection_config")))


TEXTS = f"""{POINTS}, i AS (SELECT page_id, event_id AS seq, xi, yi, CASE event_id % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'FP' || event_id % 7 WHEN 2 THEN 'DV' || event_id % 3 ELSE 'FP' END AS text FROM pt),
n AS (SELECT max(n_name) FILTER (n_nationkey = 0) AS w, max(n_name) FILTER (n_nationkey = 1) AS fp FROM nation)"""


def detected(spark, sf):
    got = detect.detected(text_items(spark, sf), types(spark, sf), 60.0)
    return got.select("page_id", "seq", "type", "uin", F.array_join("codes", ",").alias("codes"), F.array_join("families", ",").alias("families"))


DETECTED = f"""WITH {TEXTS}, d AS (SELECT a.page_id, a.seq, c.text AS code FROM i c JOIN i a ON a.page_id = c.page_id AND c.seq % 4 = 2 AND a.seq % 4 = 0 AND (a.xi - c.xi) ** 2 + (a.yi - c.yi) ** 2 < 3600
  QUALIFY row_number() OVER (PARTITION BY c.page_id, c.seq ORDER BY (a.xi - c.xi) ** 2 + (a.yi - c.yi) ** 2, a.seq) = 1),
g AS (SELECT page_id, seq, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM d GROUP BY ALL)
SELECT page_id, seq, CASE WHEN text = 'W' THEN w ELSE fp END AS type, CASE WHEN text <> 'W' THEN text END AS uin, coalesce(codes, '') AS codes, CASE WHEN codes IS NULL THEN '' ELSE 'DV' END AS families FROM i LEFT JOIN g USING (page_id, seq), n WHERE text = 'W' OR (text LIKE 'FP_')"""


def flagged_texts(spark, sf):
    return detect.matched(text_items(spark, sf), types(spark, sf)).where("flag is not null").groupBy("type", "text", "flag").agg(F.count("*").alias("n"))


FLAGGED = f"WITH {TEXTS} SELECT fp AS type, 'FP' AS text, 'prefix_only' AS flag, count(*) AS n FROM i, n WHERE text = 'FP' GROUP BY fp"


def anchor_counts(spark, sf):
    return detect.anchor_counts(text_items(spark, sf), types(spark, sf))


ANCHOR_COUNTS = f"WITH {TEXTS} SELECT page_id, count(*) AS anchors FROM i WHERE text = 'W' OR text LIKE 'FP_' GROUP BY page_id"


def sheet_items(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*[F.lit(x) for x in ("UIN", "type", "Quantity", "Note", "north")]), (k % 5 + 1).cast("int"))
    heads = o.where("o_orderkey % 20 < 5").select(F.floor(k / 20).alias("page_id"), k.alias("seq"), F.when((k % 20 == 1) & (k % 3 == 0), "wing").otherwise(word).alias("str"), (k % 5 * 0.2).alias("x"), F.lit(0.1).alias("y"))
    body = o.where("o_orderkey % 20 >= 5").select(F.floor(k / 20).alias("page_id"), k.alias("seq"), F.concat(F.lit("v"), (F.col("o_custkey") % 8).cast("string")).alias("str"), (k % 5 * 0.2).alias("x"), (0.2 + F.floor((k % 20) / 5) * 0.05).alias("y"))
    return heads.unionByName(body)


def sheet_tables(spark, sf):
    got = tables.sheet_tables(sheet_items(spark, sf))
    return got.select("page_id", F.array_join("headers", "|").alias("headers"), F.array_join("id_values", "|").alias("id_values"), "grand_total_row")


SHEET_TABLES = """WITH i AS (SELECT o_orderkey // 20 AS p, o_orderkey AS k, o_orderkey % 20 AS n, CASE WHEN o_orderkey % 20 = 1 AND o_orderkey % 3 = 0 THEN 'WING' ELSE ['UIN', 'TYPE', 'QUANTITY', 'NOTE', 'NORTH'][o_orderkey % 5 + 1] END AS w, 'V' || o_custkey % 8 AS v FROM orders),
h AS (SELECT p, string_agg(w, '|' ORDER BY n) AS headers, count(*) AS c, count(*) FILTER (w IN ('UIN', 'TYPE', 'QUANTITY')) AS hits, min(n) FILTER (w IN ('UIN', 'TYPE')) AS id FROM i WHERE n < 5 GROUP BY p)
SELECT p AS page_id, headers, coalesce(string_agg(v, '|' ORDER BY k), '') AS id_values, FALSE AS grand_total_row FROM h LEFT JOIN i USING (p) WHERE c >= 2 AND hits >= 2 AND hits / c >= 0.4 AND (i.n IS NULL OR id IS NULL OR (i.n >= 5 AND i.n % 5 = id) OR NOT EXISTS (SELECT 1 FROM i j WHERE j.p = h.p AND j.n >= 5 AND j.n % 5 = h.id)) AND (i.n >= 5 OR NOT EXISTS (SELECT 1 FROM i j WHERE j.p = h.p AND j.n >= 5 AND j.n % 5 = h.id)) GROUP BY p, headers"""


def sheet_routes(spark, sf):
    found = tables.sheet_tables(sheet_items(spark, sf)).withColumn("table_id", F.struct("page_id", "row"))
    kinds = classify.table_archetype(found.select("table_id", "headers", "grand_total_row", "id_values")).select("table_id.page_id", F.col("table_id.row").alias("table_id"), "archetype", "score")
    pages = t(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 20).alias("page_id"), (F.col("o_custkey") % 2).alias("a")).groupBy("page_id").agg(F.max("a").alias("anchors"))
    return detect.sheet_route(kinds, pages).groupBy("archetype", "route").agg(F.count("*").alias("pages"))


def reading_routes(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    pages = o.select(k.alias("page_id"), (k % 4 == 0).cast("int").alias("seeded"), (k % 3 == 0).alias("has_config"), F.when(k % 5 == 0, "quantity_matrix").alias("stored"), F.when(k % 7 != 0, "label_stamp").alias("derived"))
    return detect.reading_route(pages)


READING_ROUTES = """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN 'device_list' WHEN o_orderkey % 5 = 0 THEN 'quantity_matrix' WHEN o_orderkey % 7 <> 0 THEN 'label_stamp' ELSE 'unknown' END AS archetype,
  CASE WHEN o_orderkey % 4 = 0 THEN 'seeded_rows' WHEN o_orderkey % 3 = 0 THEN 'config' WHEN o_orderkey % 5 = 0 THEN 'stored' ELSE 'derived' END AS source FROM orders"""


def matrix_rows(spark, sf):
    li = t(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("page_id"), F.col("l_returnflag").alias("type")).agg((F.count("*") % 50).alias("quantity"))
    aliases = t(spark, sf, "region").select(F.substring("r_name", 1, 1).alias("type"), F.concat(F.lit("kind "), F.substring("r_name", 1, 1)).alias("canonical")).distinct()
    return detect.rows_of_matrix(li, aliases).groupBy("page_id", "type").agg(F.count("*").alias("n"), F.max("nth").alias("last"))


MATRIX_ROWS = """WITH q AS (SELECT l_suppkey % 40 AS page_id, l_returnflag AS f, count(*) % 50 AS n FROM lineitem GROUP BY ALL)
SELECT page_id, CASE WHEN f IN (SELECT substr(r_name, 1, 1) FROM region) THEN 'kind ' || f ELSE f END AS type, n, n AS last FROM q WHERE n > 0"""


def all_devices(spark, sf):
    found = points(spark, sf, "event_id % 3 <> 0").select("page_id", "event_id", "type", F.lit("high").alias("confidence"))
    manual = points(spark, sf, "event_id % 3 = 0").select("page_id", "event_id", "type")
    return detect.all_devices(found, manual).groupBy("page_id", "origin", "confidence").agg(F.count("*").alias("n"))


ALL_DEVICES = f"WITH {POINTS} SELECT page_id, CASE WHEN event_id % 3 = 0 THEN 'manual' ELSE 'detected' END AS origin, CASE WHEN event_id % 3 <> 0 THEN 'high' END AS confidence, count(*) AS n FROM pt GROUP BY ALL"


def merged_sources(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("sources"), F.array(F.concat(F.lit("F"), (F.col("l_suppkey") % 3).cast("string"))).alias("families"), F.array().cast("array<string>").alias("codes"))
    got = detect.merged_sources(li, ["l_orderkey"])
    return got.select("l_orderkey", F.array_join("sources", ",").alias("sources"), F.array_join("families", ",").alias("families"), F.size("codes").cast("long").alias("n_codes"))


MERGED_SOURCES = """WITH s AS (SELECT l_orderkey, l_returnflag AS s FROM lineitem UNION SELECT l_orderkey, l_linestatus FROM lineitem), f AS (SELECT l_orderkey, string_agg(DISTINCT 'F' || l_suppkey % 3, ',' ORDER BY 'F' || l_suppkey % 3) AS families FROM lineitem GROUP BY 1)
SELECT l_orderkey, string_agg(s, ',' ORDER BY s) AS sources, any_value(families) AS families, 0 AS n_codes FROM s JOIN f USING (l_orderkey) GROUP BY l_orderkey"""

PLANS = {
    "q8_read_schedule": (q8, Q8), "table_candidates": (table_candidates, TABLE_CANDIDATES), "mean_columns": (mean_columns, MEAN_COLUMNS), "detected_devices": (detected, DETECTED), "flagged_texts": (flagged_texts, FLAGGED), "anchor_counts": (anchor_counts, ANCHOR_COUNTS),
    "sheet_tables": (sheet_tables, SHEET_TABLES), "sheet_routes": (sheet_routes, None), "reading_routes": (reading_routes, READING_ROUTES), "matrix_rows": (matrix_rows, MATRIX_ROWS), "all_devices": (all_devices, ALL_DEVICES), "merged_sources": (merged_sources, MERGED_SOURCES),
}
