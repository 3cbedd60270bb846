"""Helpers shared by the training-data operators: reading tables and cutting lineage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local master may have one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = spark.conf.get("planspark.scratch", None)
    if not made:
        made = "file://" + tempfile.mkdtemp(prefix="spark-planspark-", dir="/tmp")
        spark.conf.set("planspark.scratch", made)
    return made


def written(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for the rounds of iterative jobs."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def join_counted(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined (inner or left) with right by the column key, however common a key is.

    right has one row a key, and its column ``rows`` counts left's rows with that key; it is dropped. Keys
    with over one part in ``share`` of left's rows are broadcast: there can't be more than ``share`` of them. All
    others are joined by shuffle.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.where(F.col(rows) * share > total).drop(rows)
    cold = right.where(F.col(rows) * share <= total).drop(rows)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.join(F.broadcast(hot), key).select(rest.columns).unionByName(rest)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types: extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving what it freed back to the system at its end: Spark keeps Python workers for later tasks."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
