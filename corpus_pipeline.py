"""The corpus pipeline: toxicity, language identification, near-duplicates, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.keep_harmless),
    ("language", stages.keep_identified),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("packing", stages.pack),
]

#: SQL can't express these stages; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        begin = common.mark()
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        common.release(begin, keep=docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
