"""Printed room schedules: finding their titles and headers, measuring their spacing, reading their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .classify import ROOM_KEY, table_archetype
from .graph import checkpointed
from .islands import gap_islands
from .spatial import spread

#: Header words of a room schedule's columns, the first that fits each.
COLUMNS = {"tr_number": ROOM_KEY, "terminations": r"\bTERMINATIONS\b", "patch_panels": r"\bPATCH\s*PANELS?\b", "building": r"\bBUILDING\b", "level": r"^LEVEL$"}
REQUIRED = ["tr_number", "terminations", "patch_panels"]
TITLE = r"\bSCHEDULE\b"


def locator_title(locator: Column | str) -> Column:
    """The title that a locator such as ``table titled 'X'`` names."""
    c = F.col(locator) if isinstance(locator, str) else locator
    quoted = F.regexp_extract(c, "['\"]([^'\"]+)['\"]", 1)
    return F.when(quoted != "", S.norm(quoted)).otherwise(S.norm(F.regexp_replace(c, r"(?i)^\s*table\s+titled\s+", "")))


def mean_columns(items: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """items with column, cx: each joins the first column whose running mean is within tolerance, from the left; else it begins one.

    items: keys, seq, str, x, y. A fold over the items of a band, which are few, in the order of x.
    """
    start = F.array().cast("array<struct<cx:double,sum:double,items:array<struct<x:double,y:double,seq:bigint,str:string>>>>")

    def step(acc: Column, it: Column) -> Column:
        near = F.transform(acc, lambda c, i: F.when(F.abs(it["x"] - c["cx"]) <= tolerance, i))
        at = F.array_min(F.filter(near, lambda i: i.isNotNull()))
        begun = F.struct(it["x"].alias("cx"), it["x"].alias("sum"), F.array(it).alias("items"))

        def joined(c: Column) -> Column:
            total = c["sum"] + it["x"]
            return F.struct((total / (F.size(c["items"]) + 1)).alias("cx"), total.alias("sum"), F.concat(c["items"], F.array(it)).alias("items"))

        return F.when(at.isNull(), F.concat(acc, F.array(begun))).otherwise(F.transform(acc, lambda c, i: F.when(i == at, joined(c)).otherwise(c)))

    ordered = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y", F.col("seq").cast("bigint").alias("seq"), "str"))).alias("all"))
    found = ordered.select(*keys, F.posexplode(F.aggregate("all", start, step)).alias("column", "c"))
    return found.select(*keys, "column", "c.cx", F.explode("c.items").alias("it")).select(*keys, "column", "cx", "it.*")


def column_heads(band: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """keys, column, cx, head: the texts of each column of a header band, joined from the top."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "str"))), lambda c: c["str"]), " ")
    return mean_columns(band, keys, tolerance).groupBy(*keys, "column", "cx").agg(S.norm(text).alias("head"))


def titles(items: DataFrame) -> DataFrame:
    """page_id, title, tx, ty: every text with the word SCHEDULE, the first of equal ones."""
    rows = items.withColumn("title", S.norm("str")).where(F.col("title").rlike(TITLE))
    return rows.groupBy("page_id", "title").agg(F.min_by(F.struct("x", "y"), "seq").alias("p")).select("page_id", "title", F.col("p.x").alias("tx"), F.col("p.y").alias("ty"))


def regions(items: DataFrame) -> DataFrame:
    """items with the title whose x is nearest, where they stand below it; a page has few titles, which go to its items as one array."""
    held = titles(items).groupBy("page_id").agg(F.collect_list(F.struct(F.col("tx").alias("x"), F.col("ty").alias("y"), "title")).alias("ts"))
    near = F.array_min(F.transform("ts", lambda t: F.struct(F.abs(t["x"] - F.col("x")).alias("d"), t["y"].alias("y"), t["title"].alias("title"))))
    rows = spread(items).join(held, "page_id").withColumn("_t", near)
    return rows.where(F.col("y") > F.col("_t.y") + 0.005).withColumn("title", F.col("_t.title")).drop("_t", "ts")


def candidates(items: DataFrame, band: float = 0.010, column: float = 0.012, row: float = 0.010) -> DataFrame:
    """page_id, title, archetype, heads and measured tolerances of every titled table with two columns or more.

    The header is the band below the title; gaps between its columns, its height and the steps of the first rows below give the
    tolerances that fit this table.
    """
    keys = ["page_id", "title"]
    region = regions(items)
    page = Window.partitionBy(*keys)
    region = checkpointed(region.withColumn("top", F.min("y").over(page)))
    heads = column_heads(region.where(F.col("y") <= F.col("top") + band), keys, column)
    order = Window.partitionBy(*keys).orderBy("cx")
    heads = heads.withColumn("gap", F.col("cx") - F.lag("cx").over(order))
    cols = heads.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("cx", "head"))), lambda h: h["head"]).alias("headers"), F.min("gap").alias("column_gap"), F.count("*").alias("n")).where("n >= 2")
    span = region.where(F.col("y") <= F.col("top") + band).groupBy(*keys).agg((F.max("y") - F.min("y")).alias("span"), F.max("y").alias("bottom"))
    below = region.join(span, keys).where(F.col("y") > F.col("bottom") + row / 2).select(*keys, "y").distinct()
    steps = below.withColumns({"step": F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("y")), "nth": F.row_number().over(Window.partitionBy(*keys).orderBy("y"))})
    gaps = steps.where("nth <= 6").groupBy(*keys).agg(F.min("step").alias("row_gap"))
    rows = cols.join(span, keys).join(gaps, keys, "left").withColumn("table_id", F.struct(*keys))
    kind = table_archetype(rows.select("table_id", "headers", F.lit(False).alias("grand_total_row"), F.array().cast("array<string>").alias("id_values"))).select("table_id", "archetype")
    row_gap, floor = F.coalesce("row_gap", F.lit(0.012)), F.lit(0.004)
    rows = rows.join(kind, "table_id").withColumns({"column_tol": F.greatest(F.col("column_gap") * 0.4, floor), "row_tol": F.greatest(row_gap * 0.6, floor), "band_tol": F.greatest(F.col("span") * 1.5, row_gap * 0.5, floor)})
    return rows.select(*keys, "archetype", "headers", "column_tol", "row_tol", "band_tol")


def mapped_columns(headers: Column | str) -> Column:
    """Struct of the header of each known column; null unless all required ones are there."""
    h = F.col(headers) if isinstance(headers, str) else headers
    found = {name: F.get(F.filter(h, _matches(pattern)), F.lit(0)) for name, pattern in COLUMNS.items()}
    whole = found[REQUIRED[0]].isNotNull() & found[REQUIRED[1]].isNotNull() & found[REQUIRED[2]].isNotNull()
    return F.when(whole, F.struct(*[c.alias(name) for name, c in found.items()]))


def _matches(pattern: str):
    return lambda t: t.rlike(pattern)


def proposals(found: DataFrame) -> DataFrame:
    """page_id, title, columns, tolerances and reason: the one room schedule of a page, or why there is none. found: candidates()."""
    rooms = F.when(F.col("archetype") == "tr_summary", F.struct("title", mapped_columns("headers").alias("columns"), "column_tol", "row_tol", "band_tol"))
    page = found.groupBy("page_id").agg(F.count(rooms).alias("n"), F.min_by(rooms, F.when(rooms.isNotNull(), F.col("title"))).alias("p"))
    reason = (
        F.when(F.col("n") == 0, "no candidate table classified as tr_summary").when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" candidate tables classified as tr_summary — ambiguous, needs human review")))
        .when(F.col("p.columns").isNull(), "tr_summary winner missing a required column (tr_number/terminations/patch_panels)")
    )
    return page.select("page_id", reason.alias("reason"), *[F.when(reason.isNull(), F.col(f"p.{c}")).alias(c) for c in ("title", "columns", "column_tol", "row_tol", "band_tol")])


def regions_of(items: DataFrame, config: DataFrame) -> DataFrame:
    """items below the line of their page's title, with the page's config."""
    at = titles(items).select("page_id", "title", "ty")
    return items.join(config, "page_id").join(at, ["page_id", "title"]).where(F.col("y") > F.col("ty") + F.col("row_tol") / 2).drop("ty")


def read_rooms(items: DataFrame, config: DataFrame, column_tol: float = 0.012) -> DataFrame:
    """page_id, tr_number, building, level, terminations, patch_panels of the room schedules that config names.

    A header is the first band in which all required labels stand; rows lie below it between its outermost columns, and are those
    with exactly one text for each column found, from the left, whose numbers are whole.
    """
    region = checkpointed(regions_of(items, config))
    tops = region.select("page_id", F.col("y").alias("top")).distinct()
    band = region.join(tops, "page_id").where((F.col("y") >= F.col("top")) & (F.col("y") <= F.col("top") + F.col("band_tol")))
    names = config.select("page_id", *[F.col(f"columns.{c}").alias(c) for c in COLUMNS])
    # a band can only be the header if a text in it begins each required label
    begun = [F.bool_or(F.startswith(F.col(c), S.norm("str"))) for c in REQUIRED]
    likely = band.join(names, "page_id").groupBy("page_id", "top").agg((begun[0] & begun[1] & begun[2]).alias("ok")).where("ok").select("page_id", "top")
    band = checkpointed(band.join(likely, ["page_id", "top"]))
    heads = checkpointed(column_heads(band.select("page_id", "top", "seq", "str", "x", "y"), ["page_id", "top"], column_tol))
    named = heads.join(names, "page_id").withColumn("name", F.coalesce(*[F.when(F.col("head") == F.col(c), c) for c in COLUMNS])).where("name is not null")
    firsts = named.groupBy("page_id", "top", "name").agg(F.min("cx").alias("cx"))
    bands = firsts.groupBy("page_id", "top").agg(F.array_sort(F.collect_list(F.struct(F.col("cx").alias("x"), "name"))).alias("cols"), F.count_if(F.col("name").isin(REQUIRED)).alias("required"))
    first = bands.where(F.col("required") == len(REQUIRED)).groupBy("page_id").agg(F.min(F.struct("top", "cols")).alias("b")).select("page_id", "b.top", "b.cols")
    bottom = band.join(first.select("page_id", "top"), ["page_id", "top"]).groupBy("page_id").agg(F.max("y").alias("bottom"))
    x = F.transform("cols", lambda c: c["x"])
    body = region.join(first, "page_id").join(bottom, "page_id")
    body = body.where((F.col("y") > F.col("bottom") + F.col("row_tol") / 2) & F.col("x").between(F.array_min(x) - 2 * column_tol, F.array_max(x) + 2 * column_tol))
    order = Window.partitionBy("page_id").orderBy("y", "seq")
    body = body.withColumn("row", F.sum(F.when(F.col("y") - F.lag("y").over(order) > F.col("row_tol"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = body.groupBy("page_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "str"))), lambda c: S.norm(c["str"])).alias("texts"), F.first("cols").alias("cols"))
    cells = cells.where(F.size("texts") == F.size("cols"))
    place = F.transform("cols", lambda c: c["name"])
    rows = cells.select("page_id", "row", *[F.nullif(F.get("texts", F.nullif(F.array_position(place, c), F.lit(0)) - 1), F.lit("")).alias(c) for c in COLUMNS])
    rows = rows.withColumns({c: S.to_int(c) for c in ("terminations", "patch_panels")})
    return rows.where("tr_number is not null and terminations >= 0 and patch_panels >= 0").select("page_id", "tr_number", "building", "level", "terminations", "patch_panels")


def schedule_rows(items: DataFrame) -> DataFrame:
    """Rooms of every page that has one room schedule: found, measured and read in one go."""
    config = checkpointed(proposals(candidates(items)).where("reason is null").drop("reason"))
    return read_rooms(items, config)


#: Words of a header row, and headers over values that name devices.
HEADER_WORDS = r"(?i)^(UIN|TAG|DEVICE|EQUIPMENT|OUTLET|ITEM|TYPE|QUANTITY|QTY|CABLE|HOMERUN|DETAIL|PORT|ROOM|DESIGNATOR|DESCRIPTION|HEIGHT|GRAND|TOTAL)$"
ID_HEADER = r"(?i)^(UIN|TAG|DEVICE\s*ID|EQUIPMENT\s*ID|OUTLET\s*ID|ITEM|TYPE)$"


def sheet_tables(items: DataFrame, tolerance: float = 0.006, width: float = 0.03) -> DataFrame:
    """page_id, row, headers, id_values, grand_total_row: rows of which two texts and two fifths are header words, with what stands under the id header."""
    rows = gap_islands(items.where("y is not null").withColumn("text", S.norm("str")), ["page_id"], "y", tolerance, "seq", name="row")
    word = F.col("text").rlike(HEADER_WORDS)
    heads = rows.where("text <> ''").groupBy("page_id", "row").agg(
        F.count("*").alias("n"), F.count_if(word).alias("hits"), F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "text"))), lambda c: c["text"]).alias("headers"), F.min("y").alias("hy"),
        F.min(F.when(F.col("text").rlike(ID_HEADER), F.struct("seq", "x"))).alias("id"),
    )
    heads = heads.where((F.col("n") >= 2) & (F.col("hits") >= 2) & (F.col("hits") / F.col("n") >= 0.4))
    under = rows.select("page_id", F.col("y").alias("vy"), F.col("x").alias("vx"), F.col("seq").alias("vs"), F.col("text").alias("value")).where("value <> ''")
    met = heads.where("id is not null").select("page_id", "row", "hy", "id").join(under, "page_id").where((F.col("vy") > F.col("hy") + tolerance) & (F.abs(F.col("vx") - F.col("id.x")) <= width))
    values = met.groupBy("page_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("vs", "value"))), lambda v: v["value"]).alias("id_values"))
    total = items.groupBy("page_id").agg((F.bool_or(F.upper("str").contains("GRAND")) & F.bool_or(F.upper("str").contains("TOTAL"))).alias("grand_total_row"))
    return heads.select("page_id", "row", "headers").join(values, ["page_id", "row"], "left").join(total, "page_id").withColumn("id_values", F.coalesce("id_values", F.array().cast("array<string>")))
