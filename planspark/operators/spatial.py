"""Spatial joins on a grid: points are joined by cell, then by the exact predicate.

Each point of one side is copied to the 3 x 3 cells around it, so the join is an equi-join on the cell
that Spark can hash and spread. Cells as wide as the radius keep a cell's points few where they lie
apart; keys that name the page and type cut them further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """df, whose rows explode() or a map made larger, for joins by shuffle.

    Spark estimates it by the files it comes from, takes it for small and would broadcast it through the driver.
    """
    return df.hint("merge")


def _cells(df: DataFrame, x: str, y: str, width: float | Column, around: bool) -> DataFrame:
    cx, cy = F.floor(F.col(x) / width), F.floor(F.col(y) / width)
    if not around:
        return df.withColumns({"_cx": cx, "_cy": cy})
    near = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return spread(df.withColumn("_c", F.explode(near)).select(*df.columns, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy")))


def within(left: DataFrame, right: DataFrame, radius: float | Column, keys: list[str], strict: bool = False) -> DataFrame:
    """Pairs of points of equal keys at most radius apart (less than radius if strict), with dist; radius may be one of the keys.

    left: keys, x, y and more; right: keys, rx, ry and more, no names in common but the keys.
    """
    a, b = _cells(left, "x", "y", radius, False), _cells(right, "rx", "ry", radius, True)
    met = a.join(b, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    met = met.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return met.where((F.col("dist") < radius) if strict else (F.col("dist") <= radius))


def nearest(left: DataFrame, right: DataFrame, radius: float, keys: list[str], by: list[str], *ties: Column, strict: bool = False, latest: bool = False) -> DataFrame:
    """The nearest right point of each left row (named by ``by``) within radius; ties go to the least, or if latest the greatest, of the given columns."""
    met = within(left, right, radius, keys, strict)
    if not latest:
        return _first(met, by, "dist", *ties)
    rest = [c for c in met.columns if c not in by]
    return met.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(-F.col("dist"), *ties)).alias("_x")).select(*by, "_x.*")


def nearest_by_place(left: DataFrame, right: DataFrame, radius: float, keys: list[str], by: list[str], *ties: str, strict: bool = False) -> DataFrame:
    """nearest() for points of which many stand at one place: each place looks once, and finds the least of the points at another.

    ties: columns of right, one at least.
    """
    spot, rest = [*keys, "x", "y"], [c for c in right.columns if c not in (*keys, "rx", "ry")]
    firsts = right.groupBy(*keys, "rx", "ry").agg(F.min_by(F.struct(*rest), F.struct(*ties)).alias("_x")).select(*keys, "rx", "ry", "_x.*")
    met = nearest(left.select(*spot).distinct(), firsts, radius, keys, spot, *map(F.col, ties), strict=strict)
    return _first(left.join(met, spot), by, "dist", *ties)


def _first(met: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each ``by``; tasks keep one row each before the shuffle."""
    rest = [c for c in met.columns if c not in by]
    return met.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*by, "_x.*")


def nearest_outward(left: DataFrame, right: DataFrame, first: float, limit: float, keys: list[str], by: list[str], *ties: Column) -> DataFrame:
    """nearest() within limit, looked for within first, then four times as far and so on, so cells stay small where points are near."""
    out, radius = None, first
    while True:
        got = nearest(left, right, min(radius, limit), keys, by, *ties)
        out = got if out is None else out.unionByName(got)
        if radius >= limit:
            return out
        left, radius = left.join(got.select(*by), by, "left_anti"), radius * 4


def suppressed(left: DataFrame, right: DataFrame, radius: float, keys: list[str], by: list[str]) -> DataFrame:
    """Left rows without any right point of equal keys within radius."""
    return left.join(within(left, right, radius, keys).select(*by).distinct(), by, "left_anti")


def left_adjacent(anchors: DataFrame, tokens: DataFrame, dx: float, dy: float, keys: list[str], by: list[str], *ties: Column) -> DataFrame:
    """The nearest token that stands left of each anchor, less than dx away and at most dy off its line.

    tokens: keys, rx, ry and more.
    """
    met = within(anchors, tokens, (dx * dx + dy * dy) ** 0.5, keys).where((F.col("x") - F.col("rx") > 0) & (F.col("x") - F.col("rx") <= dx) & (F.abs(F.col("y") - F.col("ry")) <= dy))
    return _first(met, by, "dist", "rx", *ties)


def in_boxes(points: DataFrame, boxes: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """Pairs of points and the boxes (x0, y0, x1, y1) over them; a box is put in all cells it covers."""
    xs, ys = F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width)), F.sequence(F.floor(F.col("y0") / width), F.floor(F.col("y1") / width))
    covered = spread(boxes.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys)))
    met = _cells(points, "x", "y", width, False).join(covered, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")
    return met.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))


def assign_pins(points: DataFrame, boxes: DataFrame, pins: DataFrame, width: float, reach: float, keys: list[str], by: list[str]) -> DataFrame:
    """The pin of each point: the first scoped box over it, else the nearest pin within reach, else null.

    boxes: keys, pin_id, pin_order and corners. pins: keys, near_pin, rx, ry. by: names a point. Points at one place have one pin: places look for it.
    """
    spot = [*keys, "x", "y"]
    places = points.select(*spot).distinct()
    firsts = boxes.groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.min_by(F.struct("pin_id", "pin_order"), "pin_order").alias("b")).select(*keys, "x0", "y0", "x1", "y1", "b.*")
    scoped = in_boxes(places, firsts, width, keys).groupBy(*spot).agg(F.min_by("pin_id", "pin_order").alias("box_pin"))
    near = nearest_outward(places, pins.groupBy(*keys, "rx", "ry").agg(F.min("near_pin").alias("near_pin")), reach / 16, reach, keys, spot, F.col("near_pin")).select(*spot, "near_pin")
    met = points.join(scoped.join(near, spot, "full"), spot, "left").select(*points.columns, "box_pin", "near_pin")
    return met.withColumns({"pin": F.coalesce("box_pin", "near_pin"), "scoped": F.col("box_pin").isNotNull()}).drop("box_pin", "near_pin")


def route(mode: Column, x: Column, y: Column, px: Column, py: Column) -> Column:
    """Length in points: straight, or right-angle for any other mode."""
    return F.when(mode == "straight", F.hypot(x - px, y - py)).otherwise(F.abs(x - px) + F.abs(y - py))


def point_to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)))
    return F.hypot(x - (ax + t * (bx - ax)), y - (ay + t * (by - ay)))
