"""Run history."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.session import materialize

RUN_SCHEMA = (
    "id bigint, timestamp timestamp, config_json string, num_results int, "
    "status string, error_message string"
)


#: Partitions of the manifest of committed runs.
BUCKETS = 16
MANIFEST_SCHEMA = "id bigint, commit string, bucket int"


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """``id, commit, bucket`` of the committed runs, or None before the first commit."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/committed")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed_ids(spark: SparkSession, root: str, offered: DataFrame) -> DataFrame:
    """Those of the offered ``id``s that are committed; only their buckets of the manifest are read."""
    known = _manifest(spark, root)
    if known is None:
        return offered.select("id").limit(0)
    # at most BUCKETS numbers reach the driver
    buckets = [r[0] for r in offered.select(_bucket("id")).distinct().collect()]
    return known.where(F.col("bucket").isin(buckets)).join(offered.select("id").distinct(), "id", "left_semi").select("id")


def append_run(root: str, runs: DataFrame, results: DataFrame) -> None:
    """Add runs (``RUN_SCHEMA``) and their output rows (plus ``run_id``); ids already committed are skipped.

    Rows are written under a commit of their own, and the manifest of committed
    ids last. What an append left behind that failed before that is never read,
    and a repeated append adds each run once.
    """
    spark, commit = runs.sparkSession, uuid.uuid4().hex
    offered = runs.select("id").union(results.select("run_id")).where("id is not null").distinct()
    offered = materialize(offered, "offered-runs")
    done = committed_ids(spark, root, offered)
    new = materialize(offered.join(done, "id", "left_anti"), "new-runs")

    def add(rows: DataFrame, key: str, path: str) -> None:
        mine = rows.join(new.withColumnRenamed("id", key), key, "left_semi").select(rows.columns)
        mine.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("commit").parquet(f"{root}/{path}")

    add(results, "run_id", "run_results")
    add(runs, "id", "runs")
    marks = new.select("id", F.lit(commit).alias("commit"), _bucket("id").alias("bucket")).repartition("bucket")
    marks.write.mode("append").partitionBy("bucket").parquet(f"{root}/committed")


def _committed(rows: DataFrame, root: str, key: str) -> DataFrame:
    known = _manifest(rows.sparkSession, root)
    if known is None:
        return rows.limit(0)
    return rows.join(known.select(F.col("id").alias(key), "commit"), [key, "commit"], "left_semi")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The committed runs."""
    rows = spark.read.schema(f"{RUN_SCHEMA}, commit string").parquet(f"{root}/runs")
    return _committed(rows, root, "id").drop("commit").select("id", "timestamp", "config_json", "num_results", "status", "error_message")


def read_run_results(spark: SparkSession, root: str) -> DataFrame:
    """The output rows of committed runs, with their ``run_id``."""
    rows = _committed(spark.read.parquet(f"{root}/run_results"), root, "run_id")
    return rows.drop("commit")


def list_runs(runs: DataFrame, n: int = 100) -> DataFrame:
    """Newest runs first, with their queries in one short text."""
    queries = F.from_json("config_json", "search_queries array<string>")["search_queries"]
    text = F.coalesce(F.array_join(queries, "; "), F.lit(""))
    newest = runs.orderBy(F.desc("id")).limit(n)
    return newest.select(
        F.col("id").alias("ID"),
        F.col("timestamp").alias("Timestamp"),
        F.when(F.length(text) > 80, F.concat(F.left(text, F.lit(77)), F.lit("...")))
        .otherwise(text)
        .alias("Queries"),
        F.col("num_results").alias("Results"),
        F.col("status").alias("Status"),
    ).orderBy(F.desc("ID"))


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    """The run, or an error at execution time when there is none."""
    missing = F.raise_error(F.lit(f"Run {run_id} not found"))
    # an aggregate over no rows is a row, which no rule of the optimizer takes away with the rows
    found = runs.where(F.col("id") == run_id).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*runs.columns)).alias("run"))
    return found.where(F.when(F.col("n") == 0, missing.cast("boolean")).otherwise(F.lit(True))).select("run.*")


def run_results(results: DataFrame, run_id: int) -> DataFrame:
    return results.where(F.col("run_id") == run_id).drop("run_id")


def run_config(runs: DataFrame, run_id: int, schema: str) -> DataFrame:
    """Configuration of a run, parsed with the given schema."""
    return get_run(runs, run_id).select(F.from_json("config_json", schema).alias("c")).select("c.*")
