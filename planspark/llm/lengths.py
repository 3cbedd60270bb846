"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are encoded and counted by encoded length, combined before the shuffle, so what moves is one
row per distinct length and task. Suffix sums over the histogram then answer, for every length L that
occurs taken as a context limit: how many documents and tokens fit, how many tokens stay when longer
documents are cut at L, and which share of documents is at most L long (the quantile function). The
sums run over blocks of lengths first and inside each block after, so no task orders all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, plain, table, written
from .tokens import WORD_BPE, encoder

BLOCK = 1024


def lengths(docs: DataFrame, tokenizer: str = WORD_BPE) -> DataFrame:
    """doc_id, n_tokens of every document; null text has no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array([len(x) for x in enc.many(pdf["text"])], np.int64) // enc.dtype.itemsize})

    return plain(docs, doc_id="long", text="string").mapInPandas(frugal(run), "doc_id long, n_tokens long")


def histogram(sizes: DataFrame) -> DataFrame:
    """From n_tokens: n_tokens, n_docs and the sums below it for each distinct length.

    docs_longer: documents over the length; tokens_longer: their tokens; tokens_at_limit: tokens kept
    of all documents when each is cut at this length; docs_share: share of documents at most this
    long, so the quantile q is the least n_tokens with docs_share >= q. Null lengths are left out; an
    empty table gives no rows.
    """
    # a row a distinct length; read twice below, counted once
    counts = written(sizes.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    order = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(order), F.lit(0)).alias("bd"), F.coalesce(F.sum("bt").over(order), F.lit(0)).alias("bt"), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(blocks, "block")
    out = out.withColumn("docs_longer", F.col("bd") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
    out = out.withColumn("tokens_longer", F.col("bt") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return out.select(
        "n_tokens", "n_docs", "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("tokens_at_limit"),
        F.col("all_tokens").alias("tokens_total"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("docs_share"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_cut, tokens_kept when documents are cut at each of a few limits (0 or more).

    Looks up the longest length at or under a limit; the documents over it keep limit tokens each.
    An empty histogram gives null counts.
    """
    fields = F.struct("n_tokens", "docs_longer", "tokens_at_limit")
    docs = F.sum("n_docs").alias("docs")
    found = hist.agg(docs, F.array(*[F.struct(F.lit(x).cast("long").alias("limit"), F.max_by(fields, F.when(F.col("n_tokens") <= x, F.col("n_tokens"))).alias("x")) for x in limits]).alias("all"))
    found = found.select("docs", F.explode("all").alias("f"))
    longer, limit = F.col("f.x.docs_longer"), F.col("f.limit")
    return found.select(
        limit.alias("context_limit"),
        F.coalesce(longer, "docs").alias("docs_cut"),
        F.coalesce(F.col("f.x.tokens_at_limit") + longer * (limit - F.col("f.x.n_tokens")), F.col("docs") * limit).alias("tokens_kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(lengths(table(spark, sf_dir, "documents")))
