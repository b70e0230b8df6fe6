"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

NAMES = {
    "op1_best_fit_packing": "packing",
    "op2_language_model": "language_model",
    "op3_license_scan": "licenses",
    "op4_sentencepiece": "pieces",
    "op5_ngram_jaccard_join": "jaccard_join",
    "op6_quality_classifier": "quality_trees",
    "op7_quality_rules": "quality_rules",
    "op8_html_extraction": "html_extract",
    "op9_language_id": "langid",
    "op10_collision_neighbours": "neighbours",
    "op11_conversation_repair": "conversations",
    "op12_merkle_fingerprints": "fingerprints",
    "op13_fill_middle": "fill_middle",
}


def queries() -> dict[str, Query]:
    return {name: getattr(import_module(f"textloom.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in NAMES.items():
        sql = getattr(import_module(f"textloom.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
