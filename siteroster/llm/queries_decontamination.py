"""Query of benchmark decontamination; tests hold it against shingle overlap of every passage and item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.decontamination import find_leaks


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                      spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ENTRIES = {"op6_benchmark_decontamination": (op6_benchmark_decontamination, None)}
