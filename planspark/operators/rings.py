"""Rings around and lines through symbols that are drawn in many short strokes: what lies near a blob is put together before it is fitted.

Each blob is a group of its own: the strokes near it are told apart by gaps in their distance, strokes of a group whose ends touch are
walked through as one, and circles and lines are fitted to the walks, never to single strokes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dashes import chain_points, ends, links, oriented_chains
from .geometry import circles, lines
from .graph import checkpointed
from .spatial import spread, within

#: Radii a ring may have (times the blob's), how far its centre may lie off; lengths of a line (times the diameter), how far it may pass.
RING, RING_OFF = (1.1, 8.0), 0.5
LINE, LINE_OFF = (1.0, 5.0), 1.0
BLOB = ["page_id", "blob"]


def near_strokes(blobs: DataFrame, strokes: DataFrame, times: float) -> DataFrame:
    """page_id, blob, radius, stroke, pts, d: strokes whose middle lies within ``times`` radii of a blob's.

    blobs: page_id, blob, x, y, radius; strokes: page_id, stroke, pts (array<struct<x, y>>). Blobs without a radius are near nothing. Cells
    are as wide as the reach of a blob, in powers of two.
    """
    reach = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("radius") * times)))
    left = blobs.where("radius > 0").select(*BLOB, "x", "y", "radius", reach.alias("_r"))
    size = F.size("pts")
    mean = lambda c: F.aggregate("pts", F.lit(0.0), lambda a, p: a + p[c]) / size
    right = spread(strokes.where(size >= 2).select("page_id", "stroke", "pts", mean("x").alias("rx"), mean("y").alias("ry")))
    right = right.join(left.select("page_id", "_r").distinct(), "page_id")
    met = within(left, right, F.col("_r"), ["page_id", "_r"])
    return met.where(F.col("dist") <= F.col("radius") * times).select(*BLOB, "radius", "stroke", "pts", F.col("dist").alias("d"))


def stitched(groups: DataFrame, touch: float) -> DataFrame:
    """grp, chain, seq, x, y: strokes of a group (grp, stroke, pts) whose ends touch, walked through; a joint is one vertex.

    Three ends at one place: the two that are nearest, of equals the first, go on. Rings come back to their first vertex.
    """
    ordered = groups.select("grp", "stroke", "pts").repartitionByRange("grp", "stroke").sortWithinPartitions("grp", "stroke")
    pieces = checkpointed(ordered.select(F.col("grp").alias("page_id"), F.monotonically_increasing_id().alias("fragment"), "pts", F.lit("").alias("cls")))
    tips = ends(pieces)
    met = links(tips, tips.select("page_id").distinct().withColumn("bridge", F.lit(float(touch))))
    points = chain_points(pieces, oriented_chains(pieces, checkpointed(met)))
    w = Window.partitionBy("page_id", "chain").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("_s", step).where(F.col("_s").isNull() | (F.col("_s") > touch)).select(F.col("page_id").alias("grp"), "chain", "seq", "x", "y")


def _name(*more: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in (*BLOB, *more)])


def ring_around(blobs: DataFrame, strokes: DataFrame, touch: float = 0.001, gap: float = 1.0) -> DataFrame:
    """page_id, blob, cx, cy, ring_radius: a ring around the middle of each blob that has one, though drawn in pieces.

    Strokes near a blob are one cluster as long as their distances to it grow by less than ``gap`` radii. Of several rings the one of the
    largest cluster counts, then the first.
    """
    met = near_strokes(blobs, strokes, RING[1] + 1 + RING_OFF)
    w = Window.partitionBy(*BLOB).orderBy("d", "stroke")
    new = F.when(F.col("d") - F.lag("d").over(w) > F.col("radius") * gap, 1).otherwise(0)
    met = met.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("grp", _name("cluster"))
    met = checkpointed(met.select("grp", *BLOB, "stroke", "pts"))
    sizes = met.groupBy("grp", *BLOB).agg(F.count("*").alias("held"))
    found = circles(stitched(met, touch), ["grp", "chain"]).select("grp", "chain", F.col("cx"), F.col("cy"), F.col("radius").alias("ring_radius"))
    rows = found.join(sizes, "grp").join(blobs.select(*BLOB, "x", "y", "radius"), BLOB)
    off, ratio = F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")), F.col("ring_radius") / F.col("radius")
    rows = rows.where((off <= F.col("radius") * RING_OFF) & ratio.between(*RING))
    return rows.groupBy(*BLOB).agg(F.min_by(F.struct("cx", "cy", "ring_radius"), F.struct(-F.col("held"), F.col("chain"))).alias("r")).select(*BLOB, "r.*")


def line_through(blobs: DataFrame, strokes: DataFrame, touch: float = 0.001) -> DataFrame:
    """page_id, blob, cx, cy, theta, length: a straight line past the middle of each blob that has one, though drawn in pieces; the first of several."""
    met = near_strokes(blobs, strokes, LINE[1] + 1 + LINE_OFF).withColumn("grp", _name())
    met = checkpointed(met.select("grp", *BLOB, "stroke", "pts"))
    found = lines(stitched(met, touch), ["grp", "chain"]).select("grp", "chain", "cx", "cy", "theta", "length")
    rows = found.join(met.select("grp", *BLOB).distinct(), "grp").join(blobs.select(*BLOB, "x", "y", "radius"), BLOB)
    past = F.abs((F.col("y") - F.col("cy")) * F.cos("theta") - (F.col("x") - F.col("cx")) * F.sin("theta"))
    rows = rows.where((past <= F.col("radius") * LINE_OFF) & (F.col("length") / (2 * F.col("radius"))).between(*LINE))
    return rows.groupBy(*BLOB).agg(F.min_by(F.struct("cx", "cy", "theta", "length"), "chain").alias("r")).select(*BLOB, "r.*")
