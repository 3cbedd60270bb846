"""Small operators over the driver's tables: page frames, family codes, locator titles, first rules, lines of unknown items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bom, detect, frames, islands, merge, tables
from ..sources import imports
from .bom_plans import t


def framed_strokes(spark, sf):
    """An order is a stroke, its lines the vertices."""
    point = F.struct(F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 600).cast("double").alias("x"), (F.col("l_suppkey") % 400).cast("double").alias("y"))
    strokes = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("pts"))
    moved = strokes.select("l_orderkey", F.posexplode(frames.page_frame("pts", F.lit(10.0), F.lit(792.0))).alias("seq", "p"))
    return moved.groupBy("l_orderkey").agg(F.count("*").alias("vertices"), F.sum("p.x").alias("x"), F.sum("p.y").alias("y"))


FRAMED = "SELECT l_orderkey, count(*) AS vertices, sum(l_partkey % 600 - 10.0::DOUBLE) AS x, sum(792.0::DOUBLE - l_suppkey % 400) AS y FROM lineitem GROUP BY l_orderkey"


def family_codes(spark, sf):
    """Tokens of orders against the families of their customer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    token = F.concat(F.when(k % 5 == 0, " ").otherwise(""), F.when(k % 4 == 0, "cam").when(k % 4 == 1, "AP").when(k % 4 == 2, "7W").otherwise("WAP"), F.when(k % 3 == 0, "").otherwise((k % 90).cast("string")))
    families = F.array(F.lit("CAM"), F.when(c % 2 == 0, "AP").otherwise("WAP"))
    rows = t(spark, sf, "orders").select("o_orderkey", token.alias("token"), families.alias("families"))
    return rows.select("o_orderkey", detect.is_family_code("token", "families").alias("is_code"))


FAMILY_CODES = """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 4 = 0 THEN 'CAM' WHEN o_orderkey % 4 = 1 THEN 'AP' WHEN o_orderkey % 4 = 2 THEN '7W' ELSE 'WAP' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE (o_orderkey % 90)::VARCHAR END AS token FROM orders)
SELECT k AS o_orderkey, regexp_matches(token, '[0-9]') AND list_contains(['CAM', CASE WHEN c % 2 = 0 THEN 'AP' ELSE 'WAP' END], regexp_extract(token, '^[A-Z]+')) AS is_code FROM r"""


def locator_titles(spark, sf):
    k = F.col("s_suppkey")
    locator = F.when(k % 3 == 0, F.concat(F.lit("table titled '"), "s_name", F.lit(" schedule'"))).when(k % 3 == 1, F.concat(F.lit("  Table  Titled   door "), "s_name")).otherwise(F.concat(F.lit('the "room  '), "s_name", F.lit('" table')))
    return t(spark, sf, "supplier").select("s_suppkey", tables.locator_title(locator).alias("title"))


LOCATORS = "SELECT s_suppkey, upper(CASE s_suppkey % 3 WHEN 0 THEN s_name || ' schedule' WHEN 1 THEN 'door ' || s_name ELSE 'room ' || s_name END) AS title FROM supplier"


def first_rules(spark, sf):
    """The first order of each customer and status, as the first sheet that states a rule."""
    rows = merge.first_of_each(t(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], F.desc("o_orderdate"), F.col("o_orderkey"))
    return rows.select("o_custkey", "o_orderstatus", "o_orderkey")


FIRST_RULES = "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) = 1"


def unknown_lines(spark, sf):
    """Lines of orders that are no items, and of parts that are in no list: every seventh order and ninth part."""
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_number"))
    items = t(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("item_key"))
    parts = t(spark, sf, "part").select(F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey")).alias("part_number"))
    return imports.import_lines(lines, items, parts).groupBy("item_key", "error").agg(F.count("*").alias("lines"), F.min("part_number").alias("first_part"))


UNKNOWN_LINES = """SELECT l_orderkey AS item_key, CASE WHEN o_orderkey IS NULL THEN 'unknown item' WHEN p_partkey IS NULL THEN 'unknown part' END AS error, count(*) AS lines, min(l_partkey) AS first_part
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 7 <> 0 LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 9 <> 0 GROUP BY ALL"""


def sorted_names(spark, sf):
    """Suppliers in natural order of names with and without leading zeros; the order is the feature."""
    name = F.concat(F.lit("TR "), F.col("s_suppkey").cast("string"))
    return bom.in_order(t(spark, sf, "supplier").select(name.alias("name"), "s_suppkey"), "name")


SORTED_NAMES = "SELECT 'TR ' || s_suppkey AS name, s_suppkey FROM supplier ORDER BY s_suppkey"

def anchored_runs(spark, sf):
    """Orders as runs on pages of about fifty, in lines that drift by a fifth of the tolerance a run."""
    k = F.col("o_orderkey")
    cy, left = F.floor(k / 1200) + F.floor(k / 300) % 4 * 0.25, (k * 7 % 5 * 8).cast("double")
    runs = t(spark, sf, "orders").select((k % 300).alias("page_id"), F.concat(F.substring("o_orderpriority", 3, 3), k.cast("string")).alias("s"), cy.alias("cy"), left.alias("x0"), (left + k % 9).alias("x1"), F.when(k % 6 == 0, 0.0).otherwise(4.0 + k % 3).alias("fs"))
    return islands.anchored_runs(runs, ["page_id"], 0.5).select("page_id", "s", "cx", "cy", "n")


ANCHORED = """WITH RECURSIVE g AS (SELECT o_orderkey AS k, o_orderkey % 300 AS page_id, substr(o_orderpriority, 3, 3) || o_orderkey AS s, o_orderkey // 1200 + o_orderkey // 300 % 4 * 0.25::DOUBLE AS cy, (o_orderkey * 7 % 5 * 8)::DOUBLE AS x0, CASE WHEN o_orderkey % 6 = 0 THEN 10 ELSE 4 + o_orderkey % 3 END::DOUBLE AS fs FROM orders),
r AS (SELECT *, x0 + k % 9 AS x1, row_number() OVER (PARTITION BY page_id ORDER BY cy, x0, s) AS i FROM g),
w AS (SELECT page_id, i, 1 AS run, cy, x0 AS first_x, x1 AS reach, fs, s AS piece FROM r WHERE i = 1 UNION ALL
  SELECT r.page_id, r.i, w.run + b.new, CASE b.new WHEN 1 THEN r.cy ELSE w.cy END, CASE b.new WHEN 1 THEN r.x0 ELSE w.first_x END, CASE b.new WHEN 1 THEN r.x1 ELSE greatest(w.reach, r.x1) END, CASE b.new WHEN 1 THEN r.fs ELSE w.fs END, CASE WHEN b.new = 0 AND r.x0 - w.reach > w.fs * 0.15 THEN ' ' ELSE '' END || r.s
  FROM w JOIN r ON r.page_id = w.page_id AND r.i = w.i + 1, LATERAL (SELECT CASE WHEN abs(r.cy - w.cy) > 0.5 OR r.x0 - w.reach > w.fs THEN 1 ELSE 0 END AS new) b)
SELECT page_id, string_agg(piece, '' ORDER BY i) AS s, (min(first_x) + max(reach)) / 2 AS cx, min(cy) AS cy, count(*) AS n FROM w GROUP BY page_id, run"""

PLANS = {
    "anchored_runs": (anchored_runs, ANCHORED),
    "framed_strokes": (framed_strokes, FRAMED), "family_codes": (family_codes, FAMILY_CODES), "locator_titles": (locator_titles, LOCATORS), "first_rules": (first_rules, FIRST_RULES), "unknown_lines": (unknown_lines, UNKNOWN_LINES), "sorted_names": (sorted_names, SORTED_NAMES),
}
