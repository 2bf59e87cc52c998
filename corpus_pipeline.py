"""From raw documents to packed training sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. A stage that finds an empty table
returns one; columns of ``documents`` beyond the five known ones pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm.decontamination import without_leaks
from panelworks.llm.hyper_language import in_known_language
from panelworks.llm.line_windows import without_repeated_lines
from panelworks.llm.signature_tree import Rule, one_of_each
from panelworks.llm.window_packing import pack
from panelworks.scale import cut_lineage

# Near duplicates: five-word shingles, four fifths of the union shared.
NEAR = Rule(words=5, percent=80)
VOCABULARY = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    return in_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text."""
    cleaned = without_repeated_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return one_of_each(docs, NEAR)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of full length."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

# Tokenizers and hyperdimensional profiles are beyond SQL; tests/llm/ holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return last(spark, docs, sf_dir)
