"""Coordinate frames, sheet guards and small column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def page_frame(points: Column | str, x0: Column, top: Column) -> Column:
    """Points of a stroke from upward to downward coordinates of the page."""
    return F.transform(F.col(points) if isinstance(points, str) else points, lambda p: F.struct((p["x"] - x0).alias("x"), (top - p["y"]).alias("y")))


def identity_frame(devices: DataFrame, boxes: DataFrame) -> DataFrame:
    """devices with x, y in the full page's frame.

    devices: page_id, x, y, xy_source, symbol_via. boxes: page_id, bx, by, bw, bh (the content box in shares
    of the page). Manual places and symbols seen on the page image are in that frame; pages without a box
    and devices without a place stay as they are.
    """
    own = (F.col("xy_source") == "manual") | ((F.col("xy_source") == "symbol") & ~F.col("symbol_via").eqNullSafe(F.lit("vector")))
    move = ~F.coalesce(own, F.lit(False)) & F.col("bw").isNotNull()
    out = devices.join(boxes, "page_id", "left")
    return out.withColumns({"x": F.when(move, F.col("bx") + F.col("x") * F.col("bw")).otherwise(F.col("x")), "y": F.when(move, 1 - F.col("by") - (1 - F.col("y")) * F.col("bh")).otherwise(F.col("y"))}).select(*devices.columns)


def strip_place(x: Column, y: Column, start: Column, end: Column, offset: Column, scale: Column) -> Column:
    """Place on the page of a place on a strip of it, three digits."""
    return F.struct(S.round_up(F.coalesce(offset, F.lit(0.0)) + x * F.coalesce(scale, F.lit(1.0)), 3).alias("x"), S.round_up(start + y * (end - start), 3).alias("y"))


def legacy_length(x: Column, y: Column, px: Column, py: Column, width: Column, height: Column, scale_in: Column, scale_ft: Column, dpi: float = 150.0) -> Column:
    """Old length rule: straight distance times 1.4, as a share of the diagonal and in feet; null without a scale."""
    dist = F.sqrt(F.pow((x - px) * width, 2) + F.pow((y - py) * height, 2)) * 1.40
    return F.struct(S.round_up(dist / F.sqrt(width * width + height * height), 3).alias("norm"), F.when(scale_in > 0, S.round_up(dist / dpi * (scale_ft / scale_in), 0)).alias("ft"))


def ports(families: Column | str) -> Column:
    """Counts of data, voice and node labels among families."""
    up = F.transform(F.coalesce(F.col(families) if isinstance(families, str) else families, F.array().cast("array<string>")), F.upper)

    def count(name: str) -> Column:
        return F.size(F.filter(up, lambda f: f == name))

    return F.struct(count("DD").alias("data"), count("DV").alias("voice"), count("N").alias("node"))


def bridge_tolerance(median: Column, override: Column) -> Column:
    """Largest gap that links dashes: what is set, else 2.5 times the median gap within 2 and 14, else 6."""
    return F.when(override.isNotNull() & (override != 0), override).when(median.isNotNull() & (median != 0), F.greatest(F.lit(2.0), F.least(F.lit(14.0), 2.5 * median))).otherwise(6.0)


def usable_scale(points_per_ft: Column, paper: Column, real: Column) -> Column:
    """The page has a scale, or an override gives one."""
    return F.coalesce(points_per_ft > 0, F.lit(False)) | F.coalesce(paper.isNotNull() & (real > 0), F.lit(False))


def limit_ft(given: Column, default: float = 295.0) -> Column:
    """The type's length limit; only an unset one takes the default, zero stays."""
    return F.coalesce(given.try_cast("double"), F.lit(default))


def sheet_class(chars: Column, fills: Column, operations: Column, least_chars: int = 200, least_fills: int = 50, least_operations: int = 2000) -> Column:
    """vector_text, vector_geometry and raster_only of a sheet from what its page holds."""
    text = F.coalesce(chars, F.lit(0)) >= least_chars
    geometry = (F.coalesce(fills, F.lit(0)) >= least_fills) | (F.coalesce(operations, F.lit(0)) >= least_operations)
    return F.struct(text.alias("vector_text"), geometry.alias("vector_geometry"), (~text & ~geometry).alias("raster_only"))


def segment_hits(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column, steps: int = 6) -> Column:
    """One of the segment's evenly spaced points (both ends too) lies in the rectangle."""
    return F.exists(F.sequence(F.lit(0), F.lit(steps)), lambda k: (ax + (bx - ax) * k / steps).between(x0, x1) & (ay + (by - ay) * k / steps).between(y0, y1))


def project_limits(rules: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """A row a project: pull limits outside and inside and the bend limit, the first rule of each kind, else the defaults.

    rules: project, seq, rule_kind, used_by_step, rule_value.
    """
    kinds = {"osp_pull_ft": ("pull_limit_ft", "WF3"), "interior_pull_ft": ("pull_limit_ft", "WF4"), "bends_deg": ("bend_limit_deg", "WF3")}
    return rules.groupBy("project").agg(*[F.coalesce(F.min_by("rule_value", F.when((F.col("rule_kind") == k) & (F.col("used_by_step") == s) & F.col("rule_value").isNotNull(), F.col("seq"))), F.lit(defaults[n])).alias(n) for n, (k, s) in kinds.items()])


def expand_counts(matrix: DataFrame, aliases: DataFrame) -> DataFrame:
    """A row a device of a matrix (page_id, type, quantity), under its type's alias where it has one."""
    rows = matrix.where("quantity > 0").join(aliases.select("type", "alias"), "type", "left")
    return rows.select("page_id", F.coalesce("alias", "type").alias("type"), F.col("type").alias("matrix_type"), F.explode(F.sequence(F.lit(1), F.col("quantity").cast("int"))).alias("nth"))


def next_candidate(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """The candidate after each project's current rank, with the score of the one behind it.

    candidates: project, rank, color, width, score. current: project, rank.
    """
    want = current.select("project", (F.col("rank") + 1).alias("rank"))
    behind = candidates.select("project", (F.col("rank") - 1).alias("rank"), F.col("score").alias("runner_up"))
    return candidates.join(want, ["project", "rank"]).join(behind, ["project", "rank"], "left")


def bom_sections(sized: DataFrame, counts: DataFrame, cells: DataFrame, feeds: DataFrame, allowances: DataFrame) -> DataFrame:
    """All item lines of the BOM model: key, item, unit, qty, step.

    sized: rule_key, qty (a row a room). counts: type, devices, cable_ft, ports. cells: tr_name, category,
    quantity. feeds: feed, core_a_note, core_b_note (confirmed). allowances: allowance_key, item, per_unit_qty,
    unit_count, confirmed. Jacks of types without a port count, and allowances without both numbers, make no line.
    """

    def line(df: DataFrame, key: Column, item: Column, unit: str, qty: Column, step: str) -> DataFrame:
        return df.select(key.alias("key"), item.alias("item"), F.lit(unit).alias("unit"), S.round_up(qty.cast("double"), 1).alias("qty"), F.lit(step).alias("step"))

    racks = sized.groupBy("rule_key").agg(F.sum(F.coalesce("qty", F.lit(0.0))).alias("qty"))
    out = line(racks, F.concat(F.lit("wf6:"), "rule_key"), F.col("rule_key"), "ea", F.col("qty"), "WF6")
    out = out.unionByName(line(counts, F.concat(F.lit("wf4:count:"), "type"), F.col("type"), "ea", F.col("devices"), "WF4"))
    out = out.unionByName(line(counts, F.concat(F.lit("wf4:ft:"), "type"), F.concat("type", F.lit(" cable")), "ft", F.col("cable_ft"), "WF4"))
    out = out.unionByName(line(counts.where("ports is not null"), F.concat(F.lit("wf4:jacks:"), "type"), F.concat("type", F.lit(" jacks")), "ea", F.col("devices") * F.col("ports"), "WF4"))
    rooms = cells.where("category not in ('wall_mount', 'rack_existing')").groupBy("category").agg(F.sum(F.coalesce("quantity", F.lit(0.0))).alias("qty"))
    out = out.unionByName(line(rooms, F.concat(F.lit("wf5:"), "category"), F.col("category"), "ea", F.col("qty"), "WF5").withColumn("unit", F.when(F.col("item") == "cable_tray", "ft").otherwise("ea")))
    cores = feeds.select(F.explode(F.array("core_a_note", "core_b_note")).alias("note")).where("note is not null").groupBy("note").agg(F.count("*").alias("cores"))
    out = out.unionByName(line(cores, F.concat(F.lit("wf7:cable:"), F.col("note").cast("string")), F.concat(F.lit("Backbone cable CN "), F.col("note").cast("string")), "runs", F.col("cores"), "WF7"))
    given = allowances.where("confirmed and per_unit_qty is not null and unit_count is not null")
    return out.unionByName(line(given, F.concat(F.lit("wf7:allow:"), "allowance_key"), F.col("item"), "ea", F.col("per_unit_qty") * F.col("unit_count"), "WF7"))


def rack_totals(sized: DataFrame, rooms: DataFrame) -> DataFrame:
    """rule_key, qty, missing: the sum of a rule over rooms, and how many rooms with a rack count have no quantity for it. sized: rule_key, tr_name, qty; rooms: tr_name, racks."""
    met = sized.join(rooms.select("tr_name", "racks"), "tr_name", "left")
    return met.groupBy("rule_key").agg(S.round_up(F.sum(F.coalesce("qty", F.lit(0.0))), 1).alias("qty"), F.count_if(F.col("racks").isNotNull() & F.col("qty").isNull()).alias("missing"))


def floor_assemblies(counts: DataFrame, ports: DataFrame) -> DataFrame:
    """type, faceplates, jacks: a faceplate a device, and its ports in jacks (null where they are not known). counts: type, devices; ports: type, ports."""
    return counts.join(ports, "type", "left").select("type", F.col("devices").alias("faceplates"), (F.col("devices") * F.col("ports")).alias("jacks"))


def room_items(cells: DataFrame) -> DataFrame:
    """category, qty, rooms: the sum of each category and in how many different rooms it stands. cells: tr_name, category, quantity."""
    return cells.where("category <> 'wall_mount'").groupBy("category").agg(S.round_up(F.sum(F.coalesce("quantity", F.lit(0.0))), 1).alias("qty"), F.count_distinct("tr_name").alias("rooms"))


def unit_colour(rgb: Column | str) -> Column:
    """Channels of 0 to 255 as shares."""
    return F.transform(F.col(rgb) if isinstance(rgb, str) else rgb, lambda v: v / 255.0)


def in_any_region(devices: DataFrame, regions: DataFrame) -> DataFrame:
    """devices (page_id, device, x, y) with in_region: some region (page_id, x0, y0, x1, y1) of the page holds it; true on pages without regions, false without a place."""
    held = regions.groupBy("page_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_rs"))
    inside = F.exists("_rs", lambda r: F.col("x").between(r["x0"], r["x1"]) & F.col("y").between(r["y0"], r["y1"]))
    return devices.join(held, "page_id", "left").withColumn("in_region", F.when(F.col("_rs").isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))).drop("_rs")
