"""Rings and lines in pieces over the driver's tables: a supplier is a symbol, drawn with a ring or a line by its id, each of many strokes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import glyphs, rings
from .bom_plans import t

#: Strokes of a ring.
PIECES = 24


def symbols(spark, sf):
    """Blobs; strokes: of every third a whole ring, of the next ones half a ring; and of every second a line of six strokes through the middle."""
    k = F.col("s_suppkey")
    blobs = t(spark, sf, "supplier").select(F.floor(k / 20).cast("long").alias("page_id"), k.cast("long").alias("blob"), (k % 20 * 100).cast("double").alias("x"), F.lit(50.0).alias("y"), (k % 4 + 2).cast("double").alias("radius"))
    around = blobs.select("*", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("i")).where(f"blob % 3 = 0 or blob % 3 = 1 and i < {PIECES // 2}")
    spot = lambda i: F.struct((F.col("x") + 5 * F.col("radius") * F.cos(i * (math.tau / PIECES))).alias("x"), (F.col("y") + 5 * F.col("radius") * F.sin(i * (math.tau / PIECES))).alias("y"))
    a, b = spot(F.col("i")), spot((F.col("i") + 1) % PIECES)
    ring = around.select("page_id", (F.col("blob") * 100 + F.col("i")).alias("stroke"), F.when(F.col("i") % 3 == 0, F.array(b, a)).otherwise(F.array(a, b)).alias("pts"))
    through = blobs.where("blob % 2 = 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    on = lambda i: F.struct((F.col("x") + (i - 3) * F.col("radius")).alias("x"), (F.col("y") + (i - 3) * F.col("radius") / 2).alias("y"))
    a, b = on(F.col("i")), on(F.col("i") + 1)
    line = through.select("page_id", (F.col("blob") * 100 + 50 + F.col("i")).alias("stroke"), F.when(F.col("i") % 2 == 0, F.array(b, a)).otherwise(F.array(a, b)).alias("pts"))
    return blobs, ring.unionByName(line)


def ringed_symbols(spark, sf):
    got = rings.ring_around(*symbols(spark, sf), touch=0.01)
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long")
    return got.select("blob", milli("cx").alias("cx"), milli("cy").alias("cy"), milli("ring_radius").alias("ring_radius"))


#: A closed walk begins at the first vertex of its first stroke, which is drawn backwards here, and comes back to it: that vertex counts twice in the middle and the radius.
RINGED = f"""WITH v AS (SELECT s_suppkey AS blob, (s_suppkey % 20 * 100)::DOUBLE AS x, (s_suppkey % 4 + 2)::DOUBLE AS r, (i + 1) % {PIECES} AS i FROM supplier, range({PIECES + 1}) t(i) WHERE s_suppkey % 3 = 0),
p AS (SELECT blob, x + 5 * r * cos(i * {math.tau / PIECES!r}) AS px, 50 + 5 * r * sin(i * {math.tau / PIECES!r}) AS py FROM v), c AS (SELECT blob, avg(px) AS cx, avg(py) AS cy FROM p GROUP BY blob)
SELECT blob, floor(any_value(cx) * 1000 + 0.5)::BIGINT AS cx, floor(any_value(cy) * 1000 + 0.5)::BIGINT AS cy, floor(avg(sqrt((px - cx) ** 2 + (py - cy) ** 2)) * 1000 + 0.5)::BIGINT AS ring_radius FROM p JOIN c USING (blob) GROUP BY blob"""


def crossed_symbols(spark, sf):
    got = rings.line_through(*symbols(spark, sf), touch=0.01)
    return got.select("blob", F.floor(F.col("length") * 1000 + 0.5).cast("long").alias("length"))


CROSSED = "SELECT s_suppkey AS blob, floor((s_suppkey % 4 + 2) * sqrt(45) * 1000 + 0.5)::BIGINT AS length FROM supplier WHERE s_suppkey % 2 = 0"


def gated_symbols(spark, sf):
    """Symbols with a ring around and a line through them."""
    blobs, strokes = symbols(spark, sf)
    return glyphs.gated(blobs, rings.ring_around(blobs, strokes, 0.01), rings.line_through(blobs, strokes, 0.01), True, True).select("page_id", "blob")


GATED = "SELECT s_suppkey // 20 AS page_id, s_suppkey AS blob FROM supplier WHERE s_suppkey % 6 = 0"

PLANS = {"ringed_symbols": (ringed_symbols, RINGED), "crossed_symbols": (crossed_symbols, CROSSED), "gated_symbols": (gated_symbols, GATED)}
