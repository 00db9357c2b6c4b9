"""Query of best-fit packing; tests hold it against a plain tokeniser and check every sequence for gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.packing import pack_documents


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ENTRIES = {"op2_best_fit_packing": (op2_best_fit_packing, None)}
