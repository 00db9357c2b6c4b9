"""Query of language-model scoring; tests hold the counts against a plain count and the model against held-out texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.lm_scoring import lm_scores


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ENTRIES = {"op7_lm_scoring": (op7_lm_scoring, None)}
