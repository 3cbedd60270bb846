"""Sinks: replace by page, upsert, append-only snapshots, and the tables that people get."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_pages(df: DataFrame, path: str, page: str = "page_id") -> None:
    """Overwrite the partitions of the pages that df holds and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(page).parquet(path)


def with_manual(fresh: DataFrame, stored: DataFrame, page: str = "page_id") -> DataFrame:
    """Freshly detected rows and the manual rows of the same pages, ready for replace_pages."""
    manual = stored.where("source = 'manual'").join(fresh.select(page).distinct(), page, "left_semi")
    return fresh.unionByName(manual, allowMissingColumns=True)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """stored with rows put in by key: the new row where there is one. Of new rows with one key the last by ``order`` counts."""
    if order:
        rest = [c for c in rows.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def replace_graph(tables: list[tuple[DataFrame, str]], page: str = "page_id") -> None:
    """replace_pages() of tables that refer to one another, children (what refers) first: no row is left that points to one that is gone for good."""
    for df, path in tables:
        replace_pages(df, path, page)


def append_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """Write a snapshot under its id, in a folder of its own that must not be there: one that exists is never changed."""
    try:
        df.write.mode("errorifexists").parquet(f"{path}/snapshot_id={snapshot_id}")
    except AnalysisException as e:
        raise ValueError(f"snapshot {snapshot_id} exists") from e


def import_template(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Every item with its assembly lines, or one blank line with quantity and waste 1."""
    out = items.select("item_key", "item").join(lines, "item_key", "left")
    return out.withColumns({"qty": F.coalesce("qty", F.lit(1.0)), "waste": F.coalesce("waste", F.lit(1.0))})


def parts_priced(parts: DataFrame, margins: DataFrame) -> DataFrame:
    """Catalog parts with the sale price that their margin gives, four digits."""
    out = parts.join(margins, "category", "left")
    return out.withColumn("sale_unit", F.round(F.col("cost_unit") / (1 - F.coalesce("margin", F.lit(0.0))), 4))
