"""Printed tables and note legends out of positioned text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .islands import gap_islands


def read_schedule(items: DataFrame, headers: DataFrame, tolerance: float, uin: str, key_column: str = "uin") -> DataFrame:
    """Records of printed schedules: page_id, row, uin, cells (map of column to text), x, y.

    items: page_id, seq, str, x, y. headers: page_id, column, hx, hy (a row a header cell of the page).
    Cells under the header belong to the nearest column (ties to the left one); rows are chained by y;
    a row is a record if its key cell matches the pattern uin. Several texts in a cell are joined.
    """
    band = headers.groupBy("page_id").agg(F.max("hy").alias("hy"), F.collect_list(F.struct(F.col("hx").alias("x"), "column")).alias("columns"))
    rows = items.join(band, "page_id").where(F.col("y") > F.col("hy") + tolerance / 2)
    nearest = F.array_min(F.transform("columns", lambda c: F.struct(F.abs(c["x"] - F.col("x")).alias("d"), c["x"].alias("x"), c["column"].alias("column"))))
    rows = gap_islands(rows.withColumn("column", nearest["column"]), ["page_id"], "y", tolerance, "x", "seq", name="row")
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "str"))), lambda c: c["str"]), " ")
    cells = rows.groupBy("page_id", "row", "column").agg(cell.alias("text"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    is_key = F.col("column") == key_column
    got = cells.groupBy("page_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("cells"), F.max(F.when(is_key, F.col("text"))).alias("uin"), F.max(F.when(is_key, F.col("cx"))).alias("x"), F.max(F.when(is_key, F.col("cy"))).alias("y"))
    return got.where(F.col("uin").rlike(uin))


def coded_notes(items: DataFrame, tolerance: float, cut: float = 6.0) -> DataFrame:
    """page_id, number, text of the numbered notes of a legend.

    items: page_id, seq, str, x, y of the legend's region. Whole numbers in its leftmost column that count
    up without a hole are markers; a note is what stands from its marker to the next; the legend ends at
    a gap over ``cut`` times the median gap between markers.
    """
    page = Window.partitionBy("page_id")
    rows = items.withColumn("left", F.min("x").over(page))
    number = F.when((F.col("x") - F.col("left") <= tolerance) & F.col("str").rlike("^[0-9]{1,3}$"), F.col("str").cast("int"))
    marks = rows.withColumn("number", number).where("number is not null")
    order = Window.partitionBy("page_id").orderBy("y", "seq")
    marks = marks.withColumn("run", F.col("number") - F.row_number().over(order))
    marks = marks.withColumn("first", F.first("run").over(order)).where("run = first").withColumn("gap", F.col("y") - F.lag("y").over(order))
    middle = marks.groupBy("page_id").agg(F.sort_array(F.collect_list("gap")).alias("gaps"))
    middle = middle.select("page_id", F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")).alias("median"))
    wide = F.coalesce((F.col("gap") > cut * F.col("median")).cast("int"), F.lit(0))
    marks = marks.join(middle, "page_id").withColumn("past", F.sum(wide).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("past = 0")
    spans = marks.select("page_id", "number", F.col("y").alias("y0"), F.coalesce(F.lead("y").over(order), F.col("y") + F.col("median") * cut).alias("y1"))
    body = rows.where(F.col("x") - F.col("left") > tolerance).join(spans, "page_id").where((F.col("y") >= F.col("y0") - tolerance) & (F.col("y") < F.col("y1") - tolerance))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "seq", "str"))), lambda c: c["str"]), " ")
    return body.groupBy("page_id", "number").agg(text.alias("text"))


#: Quantity rules that note wordings suggest, the first that fits.
RACK_RULES = [
    ("racks_plus_one", r"\bEACH SIDE\b|\bVERTICAL WIRE MANAGE"), ("strands_div_cassette", r"\bCASSETTE"), ("terminations_div_ports", r"\bSWITCH"), ("schedule_div_racks", r"\bPATCH PANEL"),
    ("per_wall_mount", r"\bWALL[- ]MOUNT"), ("unused_ru", r"\bBLANK(?:ING)? PANEL|\bFILLER"), ("per_rack", r"\bPER RACK\b|\bEACH RACK\b|\bRACK\b"), ("per_tr", r"\bPROVIDE\b"),
]


def suggested_rule(note: Column | str) -> Column:
    """The quantity rule that a rack note's wording suggests; not_stated if none."""
    t = S.norm(note)
    out = None
    for rule, pattern in RACK_RULES:
        out = F.when(t.rlike(pattern), rule) if out is None else out.when(t.rlike(pattern), rule)
    return out.otherwise("not_stated")


def title_phrases(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that look like titles: eight words at most, mostly capitals, naming a role; distinct per page."""
    t = F.trim(F.col(line))
    letters, capitals = F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.length(F.regexp_replace(t, "[^A-Z]", ""))
    ok = (F.size(F.split(t, r"\s+")) <= 8) & (letters > 0) & (capitals >= 0.6 * letters) & S.norm(line).rlike(r"\b(PLAN|SCHEDULE|LEGEND|ABBREVIATIONS?|SYMBOLS?|DETAIL|ELEVATION|TYPICAL|ENLARGED|RISER|DIAGRAM|NOTES)\b")
    return lines.where(ok).select("page_id", S.norm(line).alias("phrase")).distinct()


def sheet_scale(texts: DataFrame, text: str = "text") -> DataFrame:
    """The most common architectural scale of each sheet: page_id, ft_per_inch, count; the first seen of ties."""
    rows = texts.select("page_id", F.posexplode(S.scales(text)).alias("at", "size"))
    rows = rows.select("page_id", "at", S.round_up(1 / S.inches_of(F.col("size")), 4).alias("ft_per_inch"))
    counts = rows.groupBy("page_id", "ft_per_inch").agg(F.count("*").alias("count"), F.min("at").alias("at"))
    return counts.groupBy("page_id").agg(F.min_by(F.struct("ft_per_inch", "count"), F.struct(-F.col("count"), F.col("at"))).alias("x")).select("page_id", "x.*")
