"""Sources: spreadsheet rows with their rejects, CSV files and JSON configuration columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header, quotes, doubled quotes and line feeds inside cells."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def header_names(df: DataFrame) -> DataFrame:
    """Columns renamed to lower case with underscores for blanks and marks."""
    import re

    return df.withColumnsRenamed({c: re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns})


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column as a struct; text that is no such JSON gives null."""
    return df.withColumn(column, F.from_json(F.col(column), schema))


def import_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, errors) of imported parts: row, part_number, unit_cost, labor_min as text.

    A row needs a part number and numbers of at least zero where it gives any; of rows with one part
    number the first is valid.
    """
    pn = F.trim(F.coalesce("part_number", F.lit("")))
    clean = rows.withColumn("part_number", pn)
    for c in ("unit_cost", "labor_min"):
        text = F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[$,]", ""))
        clean = clean.withColumn(f"_{c}_given", text != "").withColumn(c, F.when(text != "", text.try_cast("double")))

    def bad(c: str):
        return F.col(f"_{c}_given") & (F.col(c).isNull() | (F.col(c) < 0))

    order = F.row_number().over(Window.partitionBy("part_number").orderBy("row"))
    problem = F.when(F.col("part_number") == "", "part number missing").when(bad("unit_cost"), "unit cost is no amount").when(bad("labor_min"), "labor is no number").when(order > 1, "part number repeated")
    checked = clean.withColumn("error", problem)
    keep = ["row", "part_number", "unit_cost", "labor_min"]
    return checked.where("error is null").select(*keep), checked.where("error is not null").select("row", "part_number", "error")


def import_lines(lines: DataFrame, items: DataFrame, parts: DataFrame) -> DataFrame:
    """Assembly lines with an error where their item or part is unknown."""
    out = lines.join(items.select("item_key", F.lit(True).alias("_i")).distinct(), "item_key", "left").join(parts.select("part_number", F.lit(True).alias("_p")).distinct(), "part_number", "left")
    return out.withColumn("error", F.when(F.col("_i").isNull(), "unknown item").when(F.col("_p").isNull(), "unknown part")).drop("_i", "_p")


def words(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The words of text runs with their share of the run's width: keys, seq, word, x0."""
    cut = runs.select(*keys, "seq", "str", "x", "width", F.posexplode(F.regexp_extract_all("str", F.lit(r"\S+"), 0)).alias("at", "word"))
    before = F.length(F.array_join(F.slice(F.regexp_extract_all("str", F.lit(r"\S+"), 0), 1, F.col("at")), " ")) + F.when(F.col("at") > 0, 1).otherwise(0)
    return cut.select(*keys, "seq", "at", "word", (F.col("x") + F.col("width") * before / F.greatest(F.length("str"), F.lit(1))).alias("x0"))
