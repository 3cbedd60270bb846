"""Leader fans: strokes that run from one place by a callout to the devices it names, counted by room."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, greedy_keep
from .spatial import within


def fans(segments: DataFrame, anchors: DataFrame, search: float = 30.0, long: float = 15.0, least: int = 1, snap: float = 3.0, merge: float = 6.0) -> DataFrame:
    """anchor, ok, reason, ox, oy, fanout: the place near each anchor where most long strokes meet, and how many tips they have.

    segments: page_id, seg, ax, ay, bx, by. anchors: page_id, anchor, x, y. A stroke counts if one end is nearer than ``search``; ends
    that snap to one place meet there; ties go to the place nearer the anchor. Tips closer than ``merge`` are one. Anchors at one place
    have one fan, which is looked for once; equal strokes go as one with their number.
    """
    every, spot = anchors, ["page_id", "x", "y"]
    anchors = checkpointed(anchors.groupBy(*spot).agg(F.min("anchor").alias("anchor")))
    segments = segments.groupBy("page_id", "ax", "ay", "bx", "by").agg(F.min("seg").alias("seg"), F.count("*").alias("times"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    strokes = checkpointed(segments.where(F.hypot(dx, dy) > long))
    ends = strokes.select("page_id", "seg", F.explode(F.array(F.struct(F.col("ax").alias("rx"), F.col("ay").alias("ry")), F.struct(F.col("bx").alias("rx"), F.col("by").alias("ry")))).alias("e")).select("page_id", "seg", "e.*")
    near = within(anchors, ends, search, ["page_id"], strict=True).select("page_id", "anchor", "x", "y", "seg").distinct()
    met = checkpointed(near.join(strokes.select("page_id", "seg", "ax", "ay", "bx", "by", "times"), ["page_id", "seg"]))
    number = met.groupBy("anchor").agg(F.sum("times").alias("strokes"))
    sides = F.array(F.struct(F.col("ax").alias("vx"), F.col("ay").alias("vy"), F.col("bx").alias("tx"), F.col("by").alias("ty"), F.lit(0).alias("side")), F.struct(F.col("bx").alias("vx"), F.col("by").alias("vy"), F.col("ax").alias("tx"), F.col("ay").alias("ty"), F.lit(1).alias("side")))
    tips = met.select("anchor", "x", "y", "seg", "times", F.explode(sides).alias("s")).select("anchor", "x", "y", "seg", "times", "s.*")
    tips = tips.withColumns({"kx": F.floor(F.col("vx") / snap + 0.5), "ky": F.floor(F.col("vy") / snap + 0.5)})
    places = tips.groupBy("anchor", "kx", "ky", "x", "y").agg(F.sum("times").alias("degree"), F.min_by(F.struct("vx", "vy"), F.struct("seg", "side")).alias("v"))
    far = (F.col("v.vx") - F.col("x")) * (F.col("v.vx") - F.col("x")) + (F.col("v.vy") - F.col("y")) * (F.col("v.vy") - F.col("y"))
    best = places.groupBy("anchor").agg(F.min(F.struct(-F.col("degree"), far.alias("far"), "kx", "ky", F.col("v.vx").alias("ox"), F.col("v.vy").alias("oy"), F.col("degree").alias("degree"))).alias("b")).select("anchor", "b.kx", "b.ky", "b.ox", "b.oy", "b.degree")
    mine = tips.join(best.where(F.col("degree") >= least), ["anchor", "kx", "ky"]).withColumn("id", F.col("seg") * 2 + F.col("side"))
    kept = greedy_keep(mine.select("anchor", "id", F.col("tx").alias("x"), F.col("ty").alias("y")), merge, ["anchor"]).groupBy("anchor").agg(F.count("*").alias("fanout"))
    found = anchors.join(number, "anchor", "left").join(best, "anchor", "left").join(kept, "anchor", "left").drop("anchor")
    rows = every.join(found, spot, "left")
    reason = F.when(F.coalesce("strokes", F.lit(0)) < least, "no_leader_segments").when(F.coalesce("degree", F.lit(0)) < least, "no_fan_origin")
    return rows.select("page_id", "anchor", "x", "y", reason.isNull().alias("ok"), reason.alias("reason"), *[F.when(reason.isNull(), F.col(c)).alias(c) for c in ("ox", "oy", "fanout")])


def room_counts(found: DataFrame, rooms: DataFrame, reach: float = 20.0) -> DataFrame:
    """room, devices, needs_review: the sum over a room's callouts; a fan whose origin is beyond reach of its callout counts as none found.

    found: fans(). rooms: anchor, room.
    """
    far = F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")) > reach
    rows = rooms.join(found, "anchor", "left").withColumn("good", F.coalesce(F.col("ok") & ~far, F.lit(False)))
    return rows.groupBy("room").agg(F.sum(F.when(F.col("good"), F.col("fanout")).otherwise(0)).alias("devices"), F.bool_or(~F.col("good")).alias("needs_review"))


def rack_rows(found: DataFrame, notes: DataFrame, reach: float = 20.0) -> DataFrame:
    """A row for each device of every resolved fan, at its origin, with the note its callout names. notes: anchor, room, note_number, category."""
    near = F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")) <= reach
    rows = found.where(F.col("ok") & near & (F.col("fanout") > 0)).join(notes, "anchor")
    return rows.select("page_id", "room", "note_number", "category", F.col("ox").alias("x"), F.col("oy").alias("y"), F.explode(F.sequence(F.lit(1).cast("bigint"), "fanout")).alias("nth"), F.lit("leader_fan").alias("source"))
