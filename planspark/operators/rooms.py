"""Rooms, risers and workflow: cell grids, feed types, head ends, counters and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Room quantities that are lengths, and those that are flags.
FEET = ["cable_tray"]
FLAGS = ["wall_mount"]


def parse_cell(category: Column | str, raw: Column | str) -> Column:
    """value and valid of an entered cell: blank is null, feet to a tenth, flags 0 or 1, counts whole and at least zero."""
    category, raw = (F.col(c) if isinstance(c, str) else c for c in (category, raw))
    text = F.trim(F.coalesce(raw, F.lit("")))
    n = F.when(text != "", text.try_cast("double"))
    feet, flag = category.isin(FEET), category.isin(FLAGS)
    ok = n.isNotNull() & (n >= 0) & (feet | (n == F.floor(n))) & (~flag | n.isin(0.0, 1.0))
    value = F.when(ok, F.when(feet, S.round_up(n, 1)).when(flag & (n == 0), None).otherwise(n))
    return F.struct(value.alias("value"), ((text == "") | F.coalesce(ok, F.lit(False))).alias("valid"))


def validate_cells(cells: DataFrame, rooms: DataFrame, categories: list[str]) -> DataFrame:
    """cells (seq, tr_name, category, raw) with their value, or why they are rejected."""
    known = rooms.select("tr_name", F.lit(True).alias("_known")).distinct()
    cell = parse_cell("category", "raw")
    order = Window.partitionBy("tr_name", "category").orderBy("seq")
    out = cells.withColumns({"_c": cell, "_n": F.row_number().over(order)}).join(known, "tr_name", "left")
    error = F.when(F.col("_known").isNull(), "unknown room").when(~F.col("category").isin(categories), "unknown column").when(~F.col("_c.valid"), "bad value").when(F.col("_n") > 1, "repeated")
    return out.select("seq", "tr_name", "category", F.when(error.isNull(), F.col("_c.value")).alias("value"), error.alias("error"))


def grid(rooms: DataFrame, values: DataFrame, categories: list[str]) -> DataFrame:
    """A row a room and a column a category, null where nothing is entered."""
    wide = values.groupBy("tr_name").pivot("category", categories).agg(F.max("value"))
    return rooms.select("tr_name").join(wide, "tr_name", "left")


def grid_summary(rows: DataFrame, categories: list[str], done: str = "done") -> DataFrame:
    """Rooms, rooms done, with values, done without and with values but not done."""
    has = F.greatest(*[F.col(c).isNotNull().cast("int") for c in categories]) == 1 if len(categories) > 1 else F.col(categories[0]).isNotNull()
    d = F.coalesce(F.col(done), F.lit(False))
    return rows.agg(F.count("*").alias("rooms"), F.count_if(d).alias("done"), F.count_if(has).alias("with_values"), F.count_if(d & ~has).alias("done_empty"), F.count_if(~d & has).alias("values_not_done"))


def feed_types(feeds: DataFrame, cables: DataFrame) -> DataFrame:
    """feed, plant and why of each riser feed from the cable notes of its two cores.

    feeds: feed, core_a_note, core_b_note. cables: note_number, isp_osp.
    """
    cores = feeds.select("feed", F.explode(F.array("core_a_note", "core_b_note")).alias("note_number")).where("note_number is not null")
    kinds = cores.join(cables.select("note_number", "isp_osp"), "note_number", "left").groupBy("feed").agg(F.collect_set("isp_osp").alias("kinds"))
    out = feeds.select("feed").join(kinds, "feed", "left")
    n = F.size("kinds")
    why = F.when(F.col("kinds").isNull(), "no cable note on either core").when(n > 1, "core A and core B cables differ in type").when(n == 0, "cable type not set")
    return out.select("feed", F.when(n == 1, F.col("kinds")[0]).alias("isp_osp"), why.alias("why"))


def head_end(callouts: DataFrame, feeds: DataFrame, cables: DataFrame) -> DataFrame:
    """Head-end callouts (core, note_number, qty) with the riser cores of the same letter and kind of cable under another note."""
    kinds = cables.where("strands_text is not null").select("note_number", "strands_text", F.coalesce("isp_osp", F.lit("")).alias("plant"))
    cores = feeds.select(F.explode(F.array(F.struct(F.lit("A").alias("core"), F.col("core_a_note").alias("n")), F.struct(F.lit("B").alias("core"), F.col("core_b_note").alias("n")))).alias("c")).select("c.core", F.col("c.n").alias("note_number"))
    counts = cores.groupBy("core", "note_number").agg(F.count("*").alias("cores")).join(kinds, "note_number").withColumnRenamed("note_number", "riser_note")
    own = callouts.join(kinds, "note_number", "left")
    met = own.join(counts, ["core", "strands_text", "plant"], "left")
    count = F.coalesce(F.sum(F.when(F.col("riser_note") != F.col("note_number"), F.col("cores"))), F.lit(0))
    return met.groupBy("core", "note_number", "qty").agg(count.alias("riser_cores")).withColumn("ok", F.col("riser_cores") == F.col("qty"))


def feed_counters(feeds: DataFrame, rooms: DataFrame) -> DataFrame:
    """Feeds in, out and added, scheduled rooms without a feed, and rooms fed twice."""
    fed = feeds.where("tr_name is not null").groupBy("tr_name").agg(F.count("*").alias("n"))
    main = feeds.agg(F.count("*").alias("riser"), F.count("tr_name").alias("fed"), F.count_if(F.col("tr_name").isNull()).alias("out"), F.count_if(F.col("match_kind") == "added").alias("added"))
    without = rooms.select("tr_name").distinct().join(fed, "tr_name", "left_anti").agg(F.count("*").alias("schedule_without_feed"))
    twice = fed.agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    return main.crossJoin(without).crossJoin(twice)  # one row each


def readiness(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """project, next step, whether the BOM may run, and how many steps wait on others.

    steps: project, step, seq, status. needs: step, needs (a short table). Stale steps come first, then
    the first that is not confirmed.
    """
    live = steps.where("status <> 'not_applicable'")
    stale, open_ = F.when(F.col("status") == "stale", F.col("seq")), F.when((F.col("status") != "confirmed") & (F.col("step") != "WF8"), F.col("seq"))
    nxt = live.groupBy("project").agg(F.min_by("step", stale).alias("stale"), F.min_by("step", open_).alias("todo"), F.count_if(F.col("step") != "WF8").alias("work"), F.count_if((F.col("step") != "WF8") & (F.col("status") != "confirmed")).alias("unconfirmed"))
    up = steps.select("project", F.col("step").alias("needs"), F.col("status").alias("up"))
    waits = live.select("project", "step").join(needs, "step").join(up, ["project", "needs"]).where("up not in ('confirmed', 'not_applicable')").groupBy("project").agg(F.countDistinct("step").alias("waiting"))
    out = nxt.join(waits, "project", "left")
    return out.select("project", F.coalesce("stale", "todo", F.lit("WF8")).alias("next_step"), ((F.col("work") > 0) & (F.col("unconfirmed") == 0)).alias("bom_ready"), F.coalesce("waiting", F.lit(0)).alias("waiting"))
