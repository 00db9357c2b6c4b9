"""Fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.session import spread


def read_pages(spark: SparkSession, path: str, fetched_only: bool = True) -> DataFrame:
    """``page_id, url, html``; pages that could not be fetched are left out.

    With ``fetched_only=False`` they stay in, so that a plan which only needs
    URLs does not read the HTML column to test it; ``visit`` drops them anyway.
    """
    pages = spark.read.parquet(path).select("page_id", "url", "html")
    return spread(pages.where(F.col("html").isNotNull()) if fetched_only else pages)
