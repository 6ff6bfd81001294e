"""The registered queries on documents and conversations, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from galeframe.llm import chat, exact, language, lines, middle, negatives, packing, pieces, quality, secrets, simhash, substrings, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_best_fit_packing": packing.query,
    "op3_line_dedup": lines.query,
    "op4_chat_formatting": chat.query,
    "op5_secret_scans": secrets.query,
    "op6_sentencepiece": pieces.query,
    "op7_quality_rules": quality.query,
    "op8_exact_dedup": exact.query,
    "op9_language_id": language.query,
    "op10_substring_dedup": substrings.query,
    "op11_exact_top_k": topk.query,
    "op12_hard_negatives": negatives.query,
    "op13_fill_in_middle": middle.query,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op3_line_dedup": lines.SQL,
    "op4_chat_formatting": chat.SQL,
    "op5_secret_scans": secrets.SQL,
    "op8_exact_dedup": exact.SQL,
    "op10_substring_dedup": substrings.SQL,
    "op11_exact_top_k": topk.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_fill_in_middle": middle.SQL,
}

if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
