"""Tables that change together: rows of pages are written beside the old ones, and one marker makes all of them count at once.

``root/<table>/<write>`` holds the rows of one write, ``root/_pages/<write>`` says for every page which write its rows are of, and
``root/_versions/<n>`` names the write that version n ends with. The marker is made last, and only if there is none: a writer that
stops before leaves nothing that is read, and of two writers that start from one version the second is told.
Readers take the last marker when they begin, so they see all tables of a version or none of it. Old writes stay for those who read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the version that this one would have made."""


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The number of the last version, 0 if there is none, and its write."""
    fs, at = _path(spark, f"{root}/_versions")
    if not fs.exists(at):
        return 0, None
    last = max((int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)
    if not last:
        return 0, None
    return last, spark.read.text(f"{root}/_versions/{last}").first()["value"]


def _mark(spark: SparkSession, root: str, number: int, write: str) -> None:
    fs, at = _path(spark, f"{root}/_versions/{number}")
    if fs.exists(at):
        raise Conflict(f"version {number} is there")
    # the marker's content goes to a name of its own first: what is seen under the number is whole
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/.{write}")
    out = fs.create(draft, False)
    out.write(bytearray(write.encode()))
    out.close()
    if not fs.rename(draft, at):
        raise Conflict(f"version {number} is there")


def read(spark: SparkSession, root: str, table: str, page: str = "page_id", at: tuple[int, str | None] | None = None) -> DataFrame | None:
    """The rows of a table in the last version, or in the version given; None before any version has it."""
    _, write = at or version(spark, root)
    if write is None:
        return None
    fs, path = _path(spark, f"{root}/{table}")
    if not fs.exists(path):
        return None
    pages = spark.read.parquet(f"{root}/_pages/{write}")
    writes = sorted({s.getPath().getName() for s in fs.listStatus(path)} & {r.write for r in pages.select("write").distinct().collect()})
    if not writes:
        return None
    # one folder for each write that still has a page: rows keep the name of their write
    rows = spark.read.option("mergeSchema", "true").option("basePath", f"{root}/{table}").parquet(*[f"{root}/{table}/{w}" for w in writes])
    return rows.join(pages.select(F.col("page").alias(page), F.col("write").alias("_write")), [page, "_write"], "left_semi").drop("_write")


def replace_together(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int, pages: DataFrame | None = None, page: str = "page_id") -> int:
    """Write rows of pages to several tables as one version after ``base``, and give its number.

    All rows of a page that any table or ``pages`` names go and the given ones come, in every table of ``tables``; a page that a
    table has no row for is empty there. Raises Conflict if another version follows base already.
    """
    last, before = version(spark, root)
    if last != base:
        raise Conflict(f"version {last} follows {base}")
    write = uuid.uuid4().hex
    named = [df.select(F.col(page).alias("page")) for df in tables.values()] + ([] if pages is None else [pages.select(F.col(page).alias("page"))])
    for name, df in tables.items():
        df.withColumn("_write", F.lit(write)).write.parquet(f"{root}/{name}/{write}")
    fresh = named[0]
    for more in named[1:]:
        fresh = fresh.unionByName(more)
    fresh = fresh.distinct().withColumn("write", F.lit(write))
    if before is not None:
        old = spark.read.parquet(f"{root}/_pages/{before}")
        fresh = fresh.unionByName(old.join(fresh.select("page"), "page", "left_anti"))
    fresh.write.parquet(f"{root}/_pages/{write}")
    _mark(spark, root, base + 1, write)
    return base + 1


def upsert_written(spark: SparkSession, root: str, table: str, rows: DataFrame, keys: list[str], order: str, buckets: int = 64) -> int:
    """Put rows in a table by key and write it: of repeated keys the row that is last by ``order`` counts. Only buckets of keys that change are written anew."""
    from .sinks import upsert

    number, write = version(spark, root)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    stored = read(spark, root, table, "bucket", (number, write))
    touched = rows.select("bucket").distinct()
    after = upsert(rows.limit(0) if stored is None else stored.join(F.broadcast(touched), "bucket", "left_semi"), rows, keys, order)
    return replace_together(spark, root, {table: after}, number, page="bucket")
