"""Device reconciliation: schedule rows, labels, symbols and leader marks become one list of devices.

Labels place the scheduled device of their number, labels without a number collapse by distance, symbols
snap in their order to the nearest placed device of their type and move it, the rest adopt scheduled devices
that have no place. Nothing is dropped: what matches nothing is a device with a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed, greedy_keep
from .spatial import nearest, within

ECHO, SNAP, COLLAPSE = 0.01, 0.02, 0.003
DEVICE = ["page_id", "device", "uin", "type", "x", "y", "xy_source", "sources", "flags"]


def _flags(*flags: Column) -> Column:
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def placed_by_label(schedule: DataFrame, labels: DataFrame, echo: float = ECHO) -> DataFrame:
    """Numbered devices: every schedule row, and every numbered label that no row has.

    schedule: page_id, uin, type, sx, sy. labels: page_id, seq, uin, type, x, y, in_region. A label on top
    of its row's own text is an echo and places nothing; labels inside plan regions beat others, later
    ones beat earlier.
    """
    named = labels.where("uin is not null").select("page_id", "uin", "seq", F.col("type").alias("label_type"), "x", "y", F.when(F.coalesce("in_region", F.lit(True)), 2).otherwise(1).alias("tier"))
    both = schedule.select("page_id", "uin", "type", "sx", "sy", F.lit(True).alias("listed")).join(named, ["page_id", "uin"], "full")
    dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    both = both.withColumn("real", F.col("seq").isNotNull() & ~F.coalesce(dx * dx + dy * dy <= echo * echo, F.lit(False)))
    order = F.when(F.col("real"), F.struct("tier", "seq"))
    got = both.groupBy("page_id", "uin").agg(
        F.max("type").alias("type"), F.max(F.coalesce("listed", F.lit(False))).alias("listed"), F.max_by(F.struct("x", "y"), order).alias("at"), F.min_by("label_type", F.when(F.col("real"), F.col("seq"))).alias("label_type"),
        F.max(F.when(F.col("real"), F.col("label_type") != F.col("type"))).alias("conflict"), F.max("real").alias("labelled"),
    )
    flags = _flags(F.when(F.col("conflict"), "type_conflict"), F.when(~F.col("listed"), "not_in_schedule"))
    sources = _flags(F.when(F.col("listed"), "schedule"), F.when(F.col("labelled"), "label"))
    # a label that only echoes a row of another page makes no device
    got = got.where(F.col("listed") | F.col("labelled"))
    return got.select("page_id", F.concat(F.lit("u:"), "uin").alias("device"), "uin", F.coalesce("type", "label_type").alias("type"), F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.when(F.col("labelled"), "label").otherwise("none").alias("xy_source"), sources.alias("sources"), flags.alias("flags"))


def collapsed(labels: DataFrame, radius: float = COLLAPSE) -> DataFrame:
    """Labels without a number: the first of each spot is the device, later ones within radius are the same."""
    bare = labels.where("uin is null").select("page_id", "type", F.col("seq").alias("id"), "x", "y")
    kept = greedy_keep(bare, radius, ["page_id", "type"])
    return kept.select("page_id", F.concat(F.lit("l:"), F.col("id").cast("string")).alias("device"), F.lit(None).cast("string").alias("uin"), "type", "x", "y", F.lit("label").alias("xy_source"), F.array(F.lit("label")).alias("sources"), F.array().cast("array<string>").alias("flags"))


def _in_order(devices: DataFrame, symbols: DataFrame, radius: float) -> DataFrame:
    """page_id, type, sym, x, y, key, nth: the target each symbol takes ("d:" and a device, or "a:" and the symbol that
    adopted one), or null and the symbol's number among those of its page and type that take none.

    A symbol moves its target, so later ones see the moved place. What a symbol sees within radius can only be
    changed by earlier ones within twice the radius; a round decides all symbols that have none of those open.
    One without a target adopts if fewer before it can miss than devices wait; until that is sure it stays open.
    """
    keys = ["page_id", "type"]
    symbols = symbols.select(*keys, "sym", "x", "y")
    earlier = symbols.select(*keys, F.col("sym").alias("by"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    before = checkpointed(within(symbols, earlier, 2 * radius, keys).where("by < sym").select("page_id", "sym", "by"))
    placed = devices.where("x is not null and not (size(sources) = 1 and sources[0] = 'symbol')")
    origins = checkpointed(placed.select(*keys, F.concat(F.lit("d:"), "device").alias("key"), F.col("device").alias("name"), F.col("x").alias("rx"), F.col("y").alias("ry")))
    waiting = devices.where("x is null and array_contains(sources, 'schedule')")
    waiting = checkpointed(waiting.select(*keys, F.col("device").alias("name"), F.row_number().over(Window.partitionBy(*keys).orderBy("device")).alias("nth")))
    room = waiting.groupBy(*keys).agg(F.count("*").alias("room"))
    nobody = [F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("missed", "boolean"), ("adopts", "boolean"), ("nth", "long"))]
    state = checkpointed(symbols.join(room, keys, "left").withColumn("room", F.coalesce("room", F.lit(0))).select("*", *nobody))
    line = Window.partitionBy(*keys).orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        named = state.where("adopts").join(waiting, [*keys, "nth"], "left").select(*keys, F.concat(F.lit("a:"), F.col("sym").cast("string")).alias("key"), "name", F.col("x").alias("rx"), F.col("y").alias("ry"))
        moved = state.where("key is not null").groupBy("page_id", "key").agg(F.max_by(F.struct("x", "y"), "sym").alias("at"))
        targets = origins.unionByName(named).join(moved, ["page_id", "key"], "left").select(*keys, "key", "name", F.coalesce("at.x", "rx").alias("rx"), F.coalesce("at.y", "ry").alias("ry"))
        opened = state.where("missed is null or (missed and adopts is null)").select("page_id", F.col("sym").alias("by"))
        ready = state.where("missed is null").select(*keys, "sym", "x", "y").join(before.join(opened, ["page_id", "by"]).select("page_id", "sym"), ["page_id", "sym"], "left_anti")
        met = within(ready, targets, radius, keys).groupBy("page_id", "sym").agg(
            F.max_by("key", F.struct(-F.col("dist"), F.col("name"), F.col("key"))).alias("hit"),
            F.min(F.struct("dist", F.col("name").isNotNull().alias("known"))).alias("least"),
            F.min_by("key", F.struct("dist", "key")).alias("low"), F.max_by("key", F.struct(-F.col("dist"), F.col("key"))).alias("high"),
        )
        # equally near targets go by their names: one that adopted without a known name yet makes the symbol wait
        decided = ready.select("page_id", "sym").join(met, ["page_id", "sym"], "left").where("hit is null or low = high or least.known").select("page_id", "sym", "hit", F.col("hit").isNull().alias("none"))
        state = state.join(decided, ["page_id", "sym"], "left").withColumns({"key": F.coalesce("key", "hit"), "missed": F.coalesce("missed", "none")}).drop("hit", "none")
        lost, unsure = (F.coalesce(F.sum(c.cast("long")).over(line), F.lit(0)) for c in (F.coalesce("missed", F.lit(False)), F.col("missed").isNull()))
        state = state.withColumns({"_lost": lost, "_open": unsure})
        adopts = F.when(F.col("missed"), F.when(F.col("_lost") + F.col("_open") < F.col("room"), True).when(F.col("_lost") >= F.col("room"), False))
        state = checkpointed(state.withColumns({"adopts": adopts, "nth": F.when(F.col("missed") & (F.col("_open") == 0), F.col("_lost") + 1)}).drop("_lost", "_open"))
        if state.where("missed is null").isEmpty():
            return state.select(*keys, "sym", "x", "y", "key", "nth")


def snapped(devices: DataFrame, symbols: DataFrame, radius: float = SNAP) -> DataFrame:
    """Devices after symbols (page_id, sym, type, x, y) took their places in order of sym: snapped, adopted, or new ones with no_uin.

    A symbol takes the nearest placed device of its type within radius, where symbols before it have put it (ties: the
    greatest device), else the next scheduled device without a place, which later symbols may take in turn; else it is new.
    """
    keys = ["page_id", "type"]
    taken = _in_order(devices, symbols, radius)
    waiting = devices.where("x is null and array_contains(sources, 'schedule')")
    waiting = waiting.select(*keys, "device", F.row_number().over(Window.partitionBy(*keys).orderBy("device")).cast("long").alias("nth"))
    free = taken.where("key is null").join(waiting, [*keys, "nth"], "left")
    moved = taken.where("key is not null").groupBy("page_id", "key").agg(F.max_by(F.struct("x", "y"), "sym").alias("at"))
    adopted = free.where("device is not null").withColumn("key", F.concat(F.lit("a:"), F.col("sym").cast("string")))
    adopted = adopted.join(moved, ["page_id", "key"], "left").select("page_id", "device", F.coalesce("at", F.struct("x", "y")).alias("a"))
    by_device = moved.where("key like 'd:%'").select("page_id", F.expr("substr(key, 3)").alias("device"), F.col("at").alias("s"))
    out = devices.join(by_device, ["page_id", "device"], "left").join(adopted, ["page_id", "device"], "left")
    at = F.coalesce("s", "a")
    out = out.select(
        "page_id", "device", "uin", "type", F.coalesce(at["x"], "x").alias("x"), F.coalesce(at["y"], "y").alias("y"), F.when(at.isNotNull(), "symbol").otherwise(F.col("xy_source")).alias("xy_source"),
        F.when(at.isNotNull(), F.array_union("sources", F.array(F.lit("symbol")))).otherwise(F.col("sources")).alias("sources"), F.when(F.col("a").isNotNull(), F.array_union("flags", F.array(F.lit("placement_inferred")))).otherwise(F.col("flags")).alias("flags"),
    )
    new = free.where("device is null").select("page_id", F.concat(F.lit("s:"), F.col("sym").cast("string")).alias("device"), F.lit(None).cast("string").alias("uin"), "type", "x", "y", F.lit("symbol").alias("xy_source"), F.array(F.lit("symbol")).alias("sources"), F.array(F.lit("no_uin")).alias("flags"))
    return out.unionByName(new)


def leader_groups(devices: DataFrame, leaders: DataFrame, radius: float = SNAP) -> DataFrame:
    """Devices after leader marks (page_id, leader, type, x, y, quantity): the nearest device becomes the first of quantity."""
    target = devices.where("x is not null").select("page_id", "type", "device", F.col("x").alias("rx"), F.col("y").alias("ry"))
    base = nearest(leaders.select("page_id", "type", "leader", "x", "y"), target, radius, ["page_id", "type"], ["page_id", "leader"], F.col("device"), latest=True).select("page_id", "leader", "device", "rx", "ry")
    mark = F.array(F.lit("leader_expanded"))
    hit = base.select("page_id", "device").distinct().withColumn("led", F.lit(True))
    out = devices.join(hit, ["page_id", "device"], "left")
    out = out.withColumns({"xy_source": F.when(F.col("led"), "leader").otherwise(F.col("xy_source")), "sources": F.when(F.col("led"), F.array_union("sources", F.array(F.lit("leader")))).otherwise(F.col("sources")), "flags": F.when(F.col("led"), F.array_union("flags", mark)).otherwise(F.col("flags"))}).drop("led")
    marks = leaders.join(base, ["page_id", "leader"], "left").withColumn("n", F.greatest(F.lit(1), F.col("quantity")) - F.when(F.col("device").isNull(), 0).otherwise(1)).where("n > 0")
    flags = F.when(F.col("device").isNull(), F.array(F.lit("leader_expanded"), F.lit("leader_unmatched"))).otherwise(mark)
    more = marks.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("page_id", F.concat_ws(":", F.lit("x"), F.col("leader").cast("string"), F.col("k").cast("string")).alias("device"), F.lit(None).cast("string").alias("uin"), "type", F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"), F.lit("leader").alias("xy_source"), F.array(F.lit("leader")).alias("sources"), flags.alias("flags"))
    return out.unionByName(more)


def scored(devices: DataFrame) -> DataFrame:
    """Devices with needs_placement set and confidence low, medium or high."""
    out = devices.withColumn("flags", F.when(F.array_contains("sources", "schedule") & F.col("x").isNull(), F.array_union("flags", F.array(F.lit("needs_placement")))).otherwise(F.col("flags")))
    guessed = F.array_contains("flags", "placement_inferred") | F.array_contains("flags", "leader_expanded")
    return out.withColumn("confidence", F.when(F.array_contains("flags", "type_conflict"), "low").when(guessed, "medium").when(F.size("sources") >= 2, "high").otherwise("medium"))


def count_devices(schedule: DataFrame, labels: DataFrame, symbols: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """All devices of all pages from the three kinds of evidence and leader marks."""
    devices = placed_by_label(schedule, labels).unionByName(collapsed(labels))
    devices = snapped(devices, symbols)
    return scored(leader_groups(devices, leaders) if leaders is not None else devices).select(*DEVICE, "confidence")
