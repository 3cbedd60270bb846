"""Quantity tables of sheets over the driver's tables: orders are segments, customers nodes, lines callouts, suppliers findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import takeoff
from .bom_plans import t

#: Sheets of the stand-in hold so many orders, about.
SHEET = 500


def quantity_table(spark, sf):
    k, o = F.col("o_orderkey"), t(spark, sf, "orders")
    page = F.floor(k / (4 * SHEET)).cast("long").alias("page_id")
    new, old = F.floor(F.col("o_totalprice") / 1000) + k % 2 * 0.5, F.floor(F.col("o_totalprice") / 3000).cast("double")
    rows = o.select(
        page, new.alias("new_ft"), old.alias("existing_ft"), (new + old).alias("total_ft"), F.when(k % 10 == 0, "").when(k % 2 == 0, "A").otherwise("B").alias("core"), (o["o_custkey"] % 30).alias("cables"), (k % 4).alias("n4"), (k % 3).alias("with_cables"),
        (k % 5).alias("spare"), (k % 2).alias("n1_fa"), (k % 7).alias("elec"), F.when(k % 3 == 0, "pipe basement").otherwise("duct bank").alias("pathway"), F.when(k % 11 == 0, "OVER 400' PULL LIMIT; BENDS >180").when(k % 13 == 0, "BENDS >180").alias("flags"),
    )
    c = F.col("c_custkey")
    nodes = t(spark, sf, "customer").select((c % 7).cast("long").alias("page_id"), F.element_at(F.array(*[F.lit(x) for x in ("MH", "HH", "JUNCTION", "END", "BEND")]), (c % 5 + 1).cast("int")).alias("type"))
    callouts = t(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / (4 * SHEET)).cast("long").alias("page_id"), F.when(F.col("l_linenumber") % 3 == 0, "NEAREST ONLY (9 ft) - verify").otherwise("leader").alias("method"))
    found = t(spark, sf, "supplier").select((F.col("s_suppkey") % 9).cast("long").alias("page_id"), F.when(F.col("s_suppkey") % 4 == 0, takeoff.CANDIDATE).otherwise(takeoff.VERIFY).alias("status"))
    return takeoff.quantities(rows, nodes, callouts, found, ["page_id"])


WIDE = f"""r AS (SELECT o_orderkey // {4 * SHEET} AS page_id, o_orderkey AS k, floor(o_totalprice / 1000)::DOUBLE + o_orderkey % 2 * 0.5::DOUBLE AS nw, floor(o_totalprice / 3000)::DOUBLE AS old, o_custkey % 30 AS cables, o_orderkey % 10 = 0 AS bare, o_orderkey % 11 = 0 AS pull, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS bent FROM orders),
s AS (SELECT page_id, sum(nw) AS i4, sum(old) AS i5, sum(nw) + sum(old) AS i6, sum(CASE WHEN k % 4 > 0 AND k % 3 <> 0 THEN nw ELSE 0 END) AS i7, sum(k % 4 * nw) AS i8, sum(k % 3 * nw) AS i9, sum(k % 5 * nw) AS i10, sum(k % 2 * nw) AS i11, sum(k % 7 * (nw + old)) AS i12, sum(k % 4 * old) AS i13,
  sum(CASE WHEN NOT bare AND k % 2 = 0 THEN cables * (nw + old) ELSE 0 END) AS i14, sum(CASE WHEN NOT bare AND k % 2 = 1 THEN cables * (nw + old) ELSE 0 END) AS i15, NULL::DOUBLE AS i16, count(*) AS i17, count(*) FILTER (bare) AS i18, sum(CASE WHEN bare THEN nw + old ELSE 0 END) AS bare_ft, count(*) FILTER (pull) AS i20, count(*) FILTER (bent) AS i21 FROM r GROUP BY page_id),
n AS (SELECT c_custkey % 7 AS page_id, {", ".join(f"count(*) FILTER (c_custkey % 5 = {i}) AS i{i}" for i in range(4))} FROM customer GROUP BY ALL), c AS (SELECT l_orderkey // {4 * SHEET} AS page_id, count(*) FILTER (l_linenumber % 3 = 0) AS i19 FROM lineitem GROUP BY ALL),
d AS (SELECT s_suppkey % 9 AS page_id, count(*) FILTER (s_suppkey % 4 = 0) AS i22, count(*) FILTER (s_suppkey % 4 <> 0) AS i23 FROM supplier GROUP BY ALL),
q AS (SELECT page_id, bare_ft, unnest([{", ".join(f"{{'place': {i}, 'v': " + ("NULL::DOUBLE" if i == 16 else f"coalesce(i{i}, 0)::DOUBLE") + "}" for i in range(24))}]) AS u FROM s LEFT JOIN n USING (page_id) LEFT JOIN c USING (page_id) LEFT JOIN d USING (page_id)),
names(place, section, item, unit, note) AS (VALUES {", ".join("(" + str(i) + ", " + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for i, row in enumerate(takeoff.ITEMS))}),
w AS (SELECT page_id, place, section, item, round_even(u.v, 0) AS quantity, CASE WHEN place = 16 THEN 'not stated' END AS quantity_text, unit, CASE WHEN place = 18 THEN format('{{:,}}', round_even(bare_ft, 0)::BIGINT) || ' ft of route' ELSE note END AS note FROM q JOIN names ON place = u.place)"""
QUANTITIES = f"WITH {WIDE} SELECT * FROM w"


def combined_table(spark, sf):
    return takeoff.combined(quantity_table(spark, sf))


COMBINED = f"WITH {WIDE} SELECT place, section, item, sum(quantity) AS quantity, any_value(quantity_text) AS quantity_text, any_value(unit) AS unit, CASE WHEN place = 18 THEN '' ELSE any_value(note) END AS note FROM w GROUP BY place, section, item"

PLANS = {"sheet_quantities": (quantity_table, QUANTITIES), "combined_quantities": (combined_table, COMBINED)}
