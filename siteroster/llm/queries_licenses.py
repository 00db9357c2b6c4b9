"""Query of the licence scan; SQL cannot state the trained part, so tests hold it against the model in plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.licenses import scan_licenses


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ENTRIES = {"op5_license_scan": (op5_license_scan, None)}
