"""Query of the secret scan; SQL cannot state the trained part, so tests hold it against a brute-force scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.secrets import secret_report


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ENTRIES = {"op9_secret_scan": (op9_secret_scan, None)}
