"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it works on all that the one before kept.
All but the last give the columns of documents, extra columns of any name among them. An empty table goes through all
stages and gives no rows; of repeated rows all stay that the stage keeps; ties are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planspark.llm import decontam, langid, linededup, packing, similar
from planspark.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null and letterless texts, and texts like none of them, go."""
    return langid.accepted(docs, langid.fit(langid.taught(docs)))


def without_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates; n_chars follows."""
    return linededup.clean(docs).withColumn("n_chars", F.length("text").cast("long"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Texts whose sets of five-word shingles have similarity 0.8 or more are linked, all of them and no others.
    """
    return similar.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens in the sources' own proportions."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_templates),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Language ID and packing can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
