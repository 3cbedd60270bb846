"""Measures of strokes from their vertices, and simplification of polylines in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from .spatial import point_to_segment, within


def vertices(paths: DataFrame, keys: list[str]) -> DataFrame:
    """One row a vertex: keys, seq, x, y of paths with points array<struct<x, y>>."""
    return paths.select(*keys, F.posexplode("points").alias("seq", "p")).select(*keys, "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def polygons(points: DataFrame, keys: list[str]) -> DataFrame:
    """Area (shoelace, closed), centroid of the vertices and bounding box of each path."""
    order = Window.partitionBy(*keys).orderBy("seq")
    nx, ny = (F.coalesce(F.lead(c).over(order), F.first(c).over(order)) for c in ("x", "y"))
    rows = points.withColumn("_cross", F.col("x") * ny - F.col("y") * nx)
    return rows.groupBy(*keys).agg((F.abs(F.sum("_cross")) / 2).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


def circles(points: DataFrame, keys: list[str], tolerance: float = 0.15, least: int = 8) -> DataFrame:
    """Paths whose vertices lie about as far from their centre: centre and radius."""
    page = Window.partitionBy(*keys)
    rows = points.withColumns({"cx": F.avg("x").over(page), "cy": F.avg("y").over(page)})
    rows = rows.withColumn("r", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    got = rows.groupBy(*keys).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.avg("r").alias("radius"), F.stddev_pop("r").alias("_s"), F.count("*").alias("n"))
    return got.where((F.col("n") >= least) & (F.col("radius") > 0) & (F.col("_s") / F.col("radius") <= tolerance)).drop("_s")


def lines(points: DataFrame, keys: list[str], tolerance: float = 0.12, least: int = 4) -> DataFrame:
    """Paths that are straight: direction, length and the largest distance from the fitted axis."""
    page = Window.partitionBy(*keys)
    xx, yy, xy = F.var_pop("x").over(page), F.var_pop("y").over(page), F.covar_pop("x", "y").over(page)
    rows = points.withColumns({"cx": F.avg("x").over(page), "cy": F.avg("y").over(page), "theta": F.atan2(2 * xy, xx - yy) / 2})
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    rows = rows.withColumns({"t": dx * F.cos("theta") + dy * F.sin("theta"), "off": F.abs(dy * F.cos("theta") - dx * F.sin("theta"))})
    got = rows.groupBy(*keys).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("theta").alias("theta"), (F.max("t") - F.min("t")).alias("length"), F.max("off").alias("residual"), F.count("*").alias("n"))
    return got.where((F.col("n") >= least) & (F.col("length") > 0) & (F.col("residual") / F.col("length") <= tolerance))


def encircled(blobs: DataFrame, rings: DataFrame, reach: float, low: float = 1.1, high: float = 8.0) -> DataFrame:
    """Blobs (page_id, blob, x, y, radius) with a ring around their centre; rings: page_id, rx, ry, ring_radius."""
    met = within(blobs, rings, reach, ["page_id"])
    ratio = F.col("ring_radius") / F.col("radius")
    return met.where((F.col("dist") <= F.col("radius") * 0.5) & ratio.between(low, high)).select("page_id", "blob").distinct()


def crossed(blobs: DataFrame, strokes: DataFrame, reach: float, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """Blobs that a straight stroke (page_id, rx, ry, theta, length) passes through its centre region."""
    met = within(blobs, strokes, reach, ["page_id"])
    off = F.abs((F.col("y") - F.col("ry")) * F.cos("theta") - (F.col("x") - F.col("rx")) * F.sin("theta"))
    ratio = F.col("length") / (2 * F.col("radius"))
    return met.where((off <= F.col("radius")) & ratio.between(low, high)).select("page_id", "blob").distinct()


def by_colour(paths: DataFrame, rgb: list[float], tolerance: float, column: str = "fill_rgb") -> DataFrame:
    """Paths whose colour is within tolerance of rgb in each channel."""
    target = F.array(*[F.lit(float(v)) for v in rgb])
    return paths.where(F.forall(F.zip_with(column, target, lambda a, b: F.abs(a - b) <= tolerance), lambda ok: F.coalesce(ok, F.lit(False))))


def dominant_width(strokes: DataFrame, keys: list[str]) -> DataFrame:
    """The width that carries the most length of each class: keys, width."""
    total = strokes.groupBy(*keys, "width").agg(F.sum("length").alias("total"))
    return total.groupBy(*keys).agg(F.max_by("width", F.struct("total", "width")).alias("width"))


def nth_value(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place floor(n * share) of the sorted values, not interpolated."""
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    return ranked.where(F.col("_r") == F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)).select(*keys, F.col(value).alias(name))


def simplify(points: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Vertices that stay under Douglas-Peucker: each round splits all spans at their farthest vertex.

    points: keys, seq, x, y. Rounds go on while a span has a vertex farther than tolerance; each splits
    all spans of all paths, so depth counts, not the number of vertices.
    """
    ends = Window.partitionBy(*keys)
    state = points.withColumn("keep", (F.col("seq") == F.min("seq").over(ends)) | (F.col("seq") == F.max("seq").over(ends)))
    state = checkpointed(state)
    while True:
        order = Window.partitionBy(*keys).orderBy("seq")
        back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
        corner = F.when(F.col("keep"), F.struct("seq", "x", "y"))
        spans = state.withColumns({"a": F.last(corner, True).over(back), "b": F.first(corner, True).over(ahead)})
        far = point_to_segment(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        spans = spans.withColumn("far", F.when(~F.col("keep"), far))
        top = spans.where(F.col("far") > tolerance).groupBy(*keys, F.col("a.seq").alias("span")).agg(F.min_by("seq", F.struct(-F.col("far"), F.col("seq"))).alias("seq")).select(*keys, "seq", F.lit(True).alias("new"))
        top = checkpointed(top)
        if not top.limit(1).count():
            return state.where("keep").drop("keep")
        state = checkpointed(state.join(top, [*keys, "seq"], "left").select(*keys, "seq", "x", "y", (F.col("keep") | F.col("new").isNotNull()).alias("keep")))
