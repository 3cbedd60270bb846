"""Incremental forms of two batch jobs: daily usage and first-seen pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_usage(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls and tokens a day and pass of a stream with created_at, pass and tokens; days close ``late`` after they end."""
    days = calls.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"), "pass")
    return days.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(F.to_date("w.start").alias("day"), "pass", "calls", "tokens")


def first_pages(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Pages of a stream whose sheet and content come for the first time within the watermark."""
    return pages.withWatermark("uploaded_at", late).dropDuplicatesWithinWatermark(["sheet_number", "content_hash"])


def first_ever(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
    """Pages of a batch of a stream whose sheet and content no batch before brought, whenever that was; they are added to the table at path.

    For foreachBatch: the table of pages seen, not the stream's state, says what is new. A batch that is run again writes the same folder again.
    """
    keys = ["sheet_number", "content_hash"]
    new = batch.dropDuplicates(keys)
    try:
        seen = batch.sparkSession.read.parquet(path).where(F.col("batch") != batch_id).select(*keys)
    except AnalysisException:  # the first batch
        seen = new.select(*keys).limit(0)
    new.join(seen, keys, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return batch.sparkSession.read.parquet(f"{path}/batch={batch_id}")
