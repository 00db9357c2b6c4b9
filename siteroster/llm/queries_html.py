"""Query of main-text extraction; tests hold the model against pages with known main text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.html_extraction import extract_main_text


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ENTRIES = {"op1_html_extraction": (op1_html_extraction, None)}
