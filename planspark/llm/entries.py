"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cosine, decontam, html, langid, lengths, linededup, media, packing, periodic, repair, secrets, simhash, substring


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixture_packing": packing.query,
        "op2_benchmark_decontamination": decontam.query,
        "op3_line_dedup": linededup.query,
        "op4_html_main_text": html.query,
        "op5_simhash_near_dedup": simhash.query,
        "op6_media_columns": media.query,
        "op7_secret_scan": secrets.query,
        "op8_substring_dedup": substring.query,
        "op9_language_id": langid.query,
        "op10_token_lengths": lengths.query,
        "op11_conversation_repair": repair.query,
        "op12_embedding_near_dedup": cosine.query,
        "op13_periodic_runs": periodic.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": linededup.ORACLE_SQL, "op11_conversation_repair": repair.ORACLE_SQL, "op12_embedding_near_dedup": cosine.ORACLE_SQL}
