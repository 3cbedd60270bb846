"""Discovery: token counts, anchors, patterns, noise and matrix schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def token_counts(items: DataFrame, keys: list[str], text: str = "str") -> DataFrame:
    """How often each normalised token comes, with its base: the leading capitals."""
    token = S.norm(text)
    return items.select(*keys, token.alias("token")).where("token <> ''").groupBy(*keys, "token").agg(F.count("*").alias("n")).withColumn("base", S.lead_capitals("token"))


def best_anchors(counts: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The anchor of each candidate (name, base, approx): the most frequent token of each base, then the base nearest approx.

    Ties go to the token that sorts first.
    """
    per_base = counts.where("base <> ''").groupBy(*keys, "base").agg(F.min_by(F.struct("token", "n"), F.struct(-F.col("n"), F.col("token"))).alias("t"))
    met = candidates.join(per_base, [*keys, "base"])
    gap = F.when(F.col("approx").isNull(), -F.col("t.n")).otherwise(F.abs(F.col("t.n") - F.col("approx")))
    best = met.groupBy(*keys, "name").agg(F.min_by("t", F.struct(gap, F.col("t.token"))).alias("t"))
    return best.select(*keys, "name", F.col("t.token").alias("anchor"), F.col("t.n").alias("freq"))


def prefix_pattern(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The pattern of the numbered tokens of each base: digits alone, or a dash and words."""
    rest = F.expr("substring(token, length(base) + 1)")
    rows = counts.where("base <> ''").withColumn("rest", rest).where((F.col("rest") != "") & (F.col("token").contains("-") | F.col("rest").rlike("[0-9]")))
    digits = F.bool_and(F.col("rest").rlike("^[0-9]+$"))
    got = rows.groupBy(*keys, "base").agg(digits.alias("digits"), F.sum("n").alias("tokens"))
    return got.select(*keys, "base", "tokens", F.when(F.col("digits"), F.concat(F.lit("^"), "base", F.lit("\\d+$"))).otherwise(F.concat(F.lit("^"), "base", F.lit("-[\\w-]+$"))).alias("pattern"))


#: Descriptions of clusters that are no devices, whether only without texts, and what they are.
NOISE = [
    ("dashed.{0,10}line|line.{0,10}pattern|routing.{0,10}path|conduit", False, "Conduit or routing line"),
    ("number.{0,20}inside|numbered.{0,10}circle|detail.{0,10}ref|callout|keynote", False, "Keynote callout or detail reference bubble"),
    (r"\barrow\b|directional|flow.{0,10}direction", True, "Directional arrow or flow indicator"),
]
MANY, MANY_REASON = 60, "High frequency with no text anchors — likely background element"


def noise_reason(description: Column | str, n_texts: Column, count: Column) -> Column:
    """Why a discovered cluster is no device, or null."""
    d = F.lower(F.coalesce(F.col(description) if isinstance(description, str) else description, F.lit("")))
    found = [F.when(d.rlike(pattern) & ((n_texts == 0) | F.lit(not bare)), reason) for pattern, bare, reason in NOISE]
    return F.coalesce(*found, F.when((count > MANY) & (n_texts == 0), MANY_REASON))


def expand_anchors(texts: Column | str) -> Column:
    """primary and associated anchors: base codes become their numbers 1 to 3 and 4 to 6, other texts stay."""
    clean = F.filter(F.transform(F.coalesce(F.col(texts) if isinstance(texts, str) else texts, F.array().cast("array<string>")), S.ascii_core), lambda t: t != "")

    def numbers(t: Column, low: int) -> Column:
        base = F.regexp_extract(t, "^([A-Z]+)[0-9]*$", 1)
        return F.transform(F.array(*[F.lit(str(low + i)) for i in range(3)]), lambda n: F.concat(base, n))

    coded = lambda t: t.rlike("^[A-Z]+[0-9]+$|^[A-Z]{1,2}$")
    primary = F.flatten(F.transform(clean, lambda t: F.when(coded(t), numbers(t, 1)).otherwise(F.array(t))))
    more = F.flatten(F.transform(F.filter(clean, coded), lambda t: numbers(t, 4)))
    return F.struct(F.array_distinct(primary).alias("primary"), F.array_distinct(more).alias("associated"))


#: Header words of a matrix schedule, of the type column, of quantities, and all that stand in its header band; how high and wide the band is.
TYPE_HEADER, TYPE_HEADERS = r"^TYPE$", r"OUTLET\s*TYPE|^TYPE$|DEVICE\s*TYPE|DESIGNATOR"
QUANTITY_HEADER, HEADER_WORDS = r"^(QUANTITY|QTY)$", r"^(OUTLET|TYPE|QUANTITY|QTY|POTS|POTN|NIPR|SIPR|BLANK|DATA|VOIP)$"
BAND_HEIGHT, BAND_WIDTH = 0.04, 0.5


def matrix_columns(cells: DataFrame) -> DataFrame:
    """page_id, type_x, quantity_x, bottom: where a page's matrix has its columns, and the lowest of the header words around its type column.

    cells: page_id, str, x, y (downward). The type column is the first cell that says just TYPE, else the first that names a type; of stacked
    quantity headers the leftmost right of it counts. Pages without either have no row.
    """
    rows = cells.select("page_id", "x", "y", S.norm("str").alias("text"))
    place = F.struct(F.when(F.col("text").rlike(TYPE_HEADER), 0).otherwise(1), "y", "x")
    head = rows.where(F.col("text").rlike(TYPE_HEADERS)).groupBy("page_id").agg(F.min_by(F.struct("x", "y"), place).alias("h")).select("page_id", F.col("h.x").alias("type_x"), F.col("h.y").alias("head_y"))
    met = rows.join(head, "page_id")
    quantity = F.min(F.when(F.col("text").rlike(QUANTITY_HEADER) & (F.col("x") > F.col("type_x")), F.col("x")))
    near = F.col("text").rlike(HEADER_WORDS) & (F.abs(F.col("x") - F.col("type_x")) < BAND_WIDTH) & (F.abs(F.col("y") - F.col("head_y")) <= BAND_HEIGHT)
    found = met.groupBy("page_id", "type_x", "head_y").agg(quantity.alias("quantity_x"), F.max(F.when(near, F.col("y"))).alias("low"))
    return found.where("quantity_x is not null").select("page_id", "type_x", "quantity_x", F.greatest("head_y", "low").alias("bottom"))


def matrix_located(cells: DataFrame, tolerance: float) -> DataFrame:
    """matrix() of the cells (with y) under the header of each page that has one, by the columns that its own header names."""
    under = cells.join(matrix_columns(cells), "page_id").where("y > bottom").withColumnsRenamed({"type_x": "_tx", "quantity_x": "_qx"})
    return _matrix(under, tolerance)


def matrix(cells: DataFrame, type_x: float, quantity_x: float, tolerance: float) -> DataFrame:
    """Types and quantities of a matrix schedule under its header, up to the grand total.

    cells: page_id, row, str, x. The type is the first short code in the type column left of the quantity
    column; its quantity is the whole number right of it that is nearest the quantity column.
    """
    return _matrix(cells.withColumns({"_tx": F.lit(type_x), "_qx": F.lit(quantity_x)}), tolerance)


def _matrix(cells: DataFrame, tolerance: float) -> DataFrame:
    text, type_x, quantity_x = S.norm("str"), F.col("_tx"), F.col("_qx")
    rows = cells.withColumn("text", text)
    joined = rows.groupBy("page_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: c["text"]), " ").alias("line"))
    total = F.regexp_extract("line", r"GRAND\s*TOTAL:?\s*(\d+)", 1)
    end = joined.where(total != "").groupBy("page_id").agg(F.min("row").alias("end"), F.min_by(total.cast("long"), "row").alias("grand_total"))
    body = rows.join(end, "page_id", "left").where("end is null or row < end")
    kinds = body.where((F.abs(F.col("x") - type_x) <= tolerance) & (F.col("x") < quantity_x - tolerance / 2)).groupBy("page_id", "row").agg(F.min_by(F.struct("text", "x"), "x").alias("k")).where(F.col("k.text").rlike("^[A-Z0-9]{1,4}$"))
    numbers = body.where(F.col("text").rlike("^[0-9]+$")).join(kinds, ["page_id", "row"]).where(F.col("x") > F.col("k.x") + tolerance / 2)
    order = Window.partitionBy("page_id", "row").orderBy(F.abs(F.col("x") - quantity_x), "x")
    best = numbers.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.groupBy("page_id", F.col("k.text").alias("type")).agg(F.sum(F.col("text").cast("long")).alias("quantity"), F.max("grand_total").alias("grand_total"))


def matrix_ties(types: DataFrame) -> DataFrame:
    """page_id, total, grand_total and whether they tie."""
    return types.groupBy("page_id").agg(F.sum("quantity").alias("total"), F.max("grand_total").alias("grand_total")).withColumn("ties", F.coalesce(F.col("total") == F.col("grand_total"), F.lit(False)))
