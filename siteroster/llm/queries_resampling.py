"""Query of importance resampling; tests hold it against a plain computation and held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.resampling import resample


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ENTRIES = {"op10_importance_resampling": (op10_importance_resampling, None)}
