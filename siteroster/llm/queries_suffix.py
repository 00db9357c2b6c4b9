"""Query of suffix deduplication; tests hold it against a count of all 200-byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.suffix_dedup import remove_repeats


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ENTRIES = {"op8_suffix_array_dedup": (op8_suffix_array_dedup, None)}
