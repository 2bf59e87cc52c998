"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "html_style_tree", "line_windows", "hyper_language", "token_orc", "decontamination", "kneser_ney", "signature_tree", "window_packing", "suffix_dedup",
    "quality_rules", "hard_negatives", "conversation_repair", "disclosure",
)
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with SQL where SQL can express it."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return keep


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and oracles of the subpackage."""
    for module in MODULES:
        import_module(f"panelworks.llm.{module}")
    return dict(QUERIES), dict(ORACLES)
