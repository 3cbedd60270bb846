"""Dashed lines over the driver's tables: events are dashes on pages of 250, users are lines of them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import dashes
from .bom_plans import t


def fragments(spark, sf):
    """A dash for each event: its place and direction by its id; some repeat a vertex, some are a point."""
    k = F.col("event_id")
    x, y, dx, dy = ((k * k * 31 + k * 17) % 301).cast("double"), ((k * k * 7 + k * 113) % 299).cast("double"), (k * k % 11 - 5).cast("double"), (k % 9 - 4).cast("double")
    p, q = F.struct(x.alias("x"), y.alias("y")), F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    pts = F.when(k % 4 == 0, F.array(p, p, q)).otherwise(F.array(p, q))
    return t(spark, sf, "events").select(F.floor(k / 250).cast("long").alias("page_id"), k.alias("fragment"), pts.alias("pts"), F.when(k % 3 == 0, "old").otherwise("new").alias("cls"))


LEAST = repr(math.cos(math.radians(dashes.CONE)))
ENDS = """f AS (SELECT event_id AS k, event_id // 250 AS page_id, ((event_id * event_id * 31 + event_id * 17) % 301)::DOUBLE AS x, ((event_id * event_id * 7 + event_id * 113) % 299)::DOUBLE AS y, (event_id * event_id % 11 - 5)::DOUBLE AS dx, (event_id % 9 - 4)::DOUBLE AS dy FROM events),
e AS (SELECT page_id, k, k * 2 AS id, x, y, coalesce(-dx / nullif(sqrt(dx * dx + dy * dy), 0), 0) AS ux, coalesce(-dy / nullif(sqrt(dx * dx + dy * dy), 0), 0) AS uy FROM f
  UNION ALL SELECT page_id, k, k * 2 + 1, x + dx, y + dy, coalesce(dx / nullif(sqrt(dx * dx + dy * dy), 0), 0), coalesce(dy / nullif(sqrt(dx * dx + dy * dy), 0), 0) FROM f),
p AS (SELECT a.page_id, a.id, b.id AS peer, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, a.ux, a.uy, b.ux AS vx, b.uy AS vy, b.x - a.x AS dx, b.y - a.y AS dy FROM e a JOIN e b ON a.page_id = b.page_id AND a.k <> b.k AND abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30),
g AS (SELECT page_id, id, min(d) AS gap FROM p WHERE d > 0.3 AND d <= 30 GROUP BY ALL), s AS (SELECT page_id, list_sort(list(gap)) AS gaps FROM g GROUP BY page_id)"""


def dash_gaps(spark, sf):
    tips = dashes.ends(fragments(spark, sf))
    return dashes.gap_shares(tips).join(dashes.bridges(tips), "page_id")


GAPS = f"""WITH {ENDS} SELECT page_id, {", ".join(f"floor(gaps[(floor(len(gaps) * {k}) + 1)::INT] * 100 + 0.5) / 100 AS p{int(k * 100)}" for k in (0.1, 0.25, 0.5, 0.75, 0.9))}, greatest(2.0::DOUBLE, least(14.0::DOUBLE, 2.5 * gaps[len(gaps) // 2 + 1])) AS bridge FROM s"""


def dash_links(spark, sf):
    tips = dashes.ends(fragments(spark, sf))
    return dashes.links(tips, dashes.bridges(tips)).select("a", "b", F.floor(F.col("dist") * 1000 + 0.5).cast("long").alias("milli"))


DASH_LINKS = f"""WITH {ENDS}, w AS (SELECT DISTINCT e.page_id, CASE WHEN gaps IS NULL THEN 6.0::DOUBLE ELSE greatest(2.0::DOUBLE, least(14.0::DOUBLE, 2.5 * gaps[len(gaps) // 2 + 1])) END AS bridge FROM e LEFT JOIN s USING (page_id)),
n AS (SELECT id, min((d, peer)) AS m FROM p JOIN w USING (page_id) WHERE d <= bridge AND (d <= 1 OR ux * (dx / nullif(d, 0)) + uy * (dy / nullif(d, 0)) >= {LEAST} AND vx * -(dx / nullif(d, 0)) + vy * -(dy / nullif(d, 0)) >= {LEAST}) GROUP BY id)
SELECT x.id AS a, y.id AS b, floor(x.m[1] * 1000 + 0.5)::BIGINT AS milli FROM n x JOIN n y ON x.m[2] = y.id AND y.m[2] = x.id WHERE x.id < y.id"""


def walks(spark, sf):
    """A user's events hang together in their order, each drawn either way round; of every fifth user they close a ring."""
    from pyspark.sql import Window

    e = t(spark, sf, "events").select("user_id", F.col("event_id").alias("fragment"))
    w = Window.partitionBy("user_id").orderBy("fragment")
    first = F.first("fragment").over(w)
    after = F.coalesce(F.lead("fragment").over(w), F.when((F.col("user_id") % 5 == 0) & (first != F.col("fragment")), first))
    joined = e.withColumn("after", after).where("after is not null").select((F.col("fragment") * 2 + 1 - F.floor(F.col("fragment") / 7) % 2).alias("p"), (F.col("after") * 2 + F.floor(F.col("after") / 7) % 2).alias("q"))
    return dashes.oriented_chains(e, joined.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()).select("chain", "fragment", F.col("position").cast("long").alias("position"), "reversed")


WALKS = """WITH o AS (SELECT user_id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, min(event_id) OVER (PARTITION BY user_id) AS head FROM events)
SELECT head AS chain, k AS fragment, CASE WHEN head // 7 % 2 = 0 THEN i WHEN user_id % 5 = 0 THEN (n - i) % n ELSE n - 1 - i END AS position, (k // 7 + head // 7) % 2 = 1 AS reversed FROM o"""


def dashed_lines(spark, sf):
    """Lines of all pages, each dash of them once."""
    rows = dashes.dashed_lines(fragments(spark, sf))
    return rows.groupBy("page_id", "chain").agg(F.count("*").alias("vertices"), F.count_if(F.col("cls") == "new").alias("new_vertices"), F.min_by(F.struct("x", "y"), "seq").alias("tip")).select("page_id", "chain", "vertices", "new_vertices", "tip.x", "tip.y")


PLANS = {"dash_gaps": (dash_gaps, GAPS), "dash_links": (dash_links, DASH_LINKS), "oriented_chains": (walks, WALKS), "dashed_lines": (dashed_lines, None)}
