"""Stored search results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.functions.urls import query_slug

LIST_FIELDS = "title: string, url: string"


def read_result_lists(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, one array of ``{title, url}`` per query.

    The query slug is the ``query_slug=…`` folder of the file, else its name; the
    rank is the place in the file's array, however files are packed into tasks.
    """
    files = spark.read.text(path, wholetext=True)
    slug = F.coalesce(
        F.nullif(F.regexp_extract("_metadata.file_path", "/query_slug=([^/]*)/", 1), F.lit("")),
        F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1),
    )
    listed = files.select(slug.alias("query_slug"), F.posexplode(F.from_json("value", f"array<struct<{LIST_FIELDS}>>")).alias("rank", "r"))
    return listed.select("query_slug", F.col("rank").cast("long").alias("rank"), "r.title", "r.url").where(
        "title is not null")


def write_search_results(results: DataFrame, path: str, config_hash: str) -> None:
    """Store results per configuration and query; a re-run replaces only its own queries.

    ``results`` holds ``query_pos, query, rank, title, url``.
    """
    (
        results.withColumn("config_hash", F.lit(config_hash))
        .withColumn("query_slug", query_slug("query"))
        .hint("rebalance", "query_slug")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("config_hash", "query_slug")
        .parquet(path)
    )


def read_search_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def usable_cache(results: DataFrame, queries: Sequence[str], config_hash: str) -> DataFrame:
    """Rows of the wanted queries under this hash, or nothing unless every
    wanted query is present (S4)."""
    spark = results.sparkSession
    wanted = spark.createDataFrame([(q,) for q in queries], "query string").select(
        query_slug("query").alias("query_slug")
    )
    usable = results.where(F.col("config_hash") == config_hash)
    present = usable.select("query_slug").distinct()
    missing = wanted.join(present, "query_slug", "left_anti")
    return usable.join(wanted.distinct(), "query_slug", "left_semi").where(~missing.exists())
