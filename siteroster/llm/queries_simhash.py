"""Query of SimHash near-duplicates; tests hold it against all pairs of fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.llm.simhash import near_duplicates


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ENTRIES = {"op3_simhash_near_dedup": (op3_simhash_near_dedup, None)}
