"""Contacts from a stream of fetched pages (ST1–ST4).

Each micro-batch replaces its own ``batch_id`` partition of the sink, so a
batch replayed after a lost driver or executor never adds rows twice, and the
sink can be read at any time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

from siteroster.config import DirectoryConfig
from siteroster.functions.urls import extract_domain
from siteroster.operators.filters import CONTACT_FIELDS
from siteroster.operators.similar import deduplicate
from siteroster.plans.contacts import extract_contacts
from siteroster.session import session_settings, state_settings
from siteroster.sources.output import to_output

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_page_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
        .where("html is not null")
    )


def dealt(pages: DataFrame) -> DataFrame:
    """Each batch of a page stream dealt to all cores, whatever its files.

    A batch of few large files has few splits, and rules take milliseconds a page:
    moving the HTML once is a small part of that.
    """
    return pages.repartition(2 * pages.sparkSession.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class Progress:
    """State of a stream after a batch: rows of the batch and of all so far, rows with a contact field, and the expected number."""

    batch_id: int
    rows: int
    completed: int
    found: int
    total: int | None


def _progress_path(sink: str) -> str:
    return sink.rstrip("/") + "-progress"


def write_batch(
    rows: DataFrame, sink: str, batch_id: int,
    on_metrics: Callable[[Progress], None] | None = None, total: int | None = None,
) -> None:
    """Replace the batch's partition of the sink.

    The counts are observed while the rows are written, and kept as one row a batch
    beside the sink, so neither the hook nor a snapshot counts the sink's rows.
    """
    spark, seen = rows.sparkSession, Observation()
    found = F.coalesce(*[F.col(c) for c in CONTACT_FIELDS]).isNotNull()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(found).alias("found"))
    _replace(observed, sink, batch_id)
    facts = seen.get
    _replace(spark.createDataFrame([(facts["rows"], facts["found"])], "rows bigint, found bigint"), _progress_path(sink), batch_id)
    if on_metrics is not None:
        sums = _progress(spark, sink).where(F.col("batch_id") <= batch_id).agg(F.sum("rows"), F.sum("found")).first()
        on_metrics(Progress(batch_id, facts["rows"], sums[0], sums[1], total))


def _progress(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema("rows bigint, found bigint, batch_id int").parquet(_progress_path(sink))


def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
    (
        rows.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


class FirstOfDomain(StatefulProcessor):
    """Lets the first row of a domain pass, by ``page_id`` in its batch, and none ever after."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        first = None
        for part in rows:
            first = pd.concat([first, part]).sort_values("page_id", na_position="last").head(1)
        self.seen.update((True,))
        yield first.drop(columns="domain")

    def close(self) -> None:
        pass


def first_of_domains(rows: DataFrame) -> DataFrame:
    """First row per site over all batches of a stream of contact rows.

    The domains seen so far are keyed state: a batch reads those of its own rows only.
    """
    keyed = rows.withColumn("domain", F.coalesce(extract_domain("url"), F.lit("")))
    return keyed.groupBy("domain").transformWithStateInPandas(FirstOfDomain(), rows.schema, "append", "none")


def stream_contacts(
    pages: DataFrame,
    config: DirectoryConfig,
    sink: str,
    checkpoint: str,
    unique_domains: bool = False,
    on_progress: Callable[[int, DataFrame], None] | None = None,
    on_metrics: Callable[[Progress], None] | None = None,
    total: int | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Contact rows of each arriving batch of pages (ST1); with ``unique_domains``
    only the first row per site over all batches (ST2).

    ``on_progress(batch_id, sink_rows)`` and ``on_metrics(progress)`` run after each
    batch; stopping the query keeps what was written. ``partitions`` is the number of
    partitions of the seen domains' state, the session's shuffle partitions unless given.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch if unique_domains else extract_contacts(batch, config)
        write_batch(rows, sink, batch_id, on_metrics, total)
        if on_progress is not None:
            on_progress(batch_id, batch.sparkSession.read.parquet(sink))

    source = dealt(pages)
    if unique_domains:
        source = first_of_domains(extract_contacts(source, config))
    with session_settings(pages.sparkSession, state_settings(partitions)):
        return (
            source.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def live_snapshot(spark: SparkSession, sink: str, total: int | None = None) -> DataFrame:
    """``batch_id, completed, found, total``: rows finished up to and including each batch (ST3).

    Read from the counts that the batches left, one row each; the sink is not scanned.
    """
    so_far = Window.orderBy("batch_id")
    return _progress(spark, sink).select(
        "batch_id",
        F.sum("rows").over(so_far).alias("completed"),
        F.sum("found").over(so_far).alias("found"),
        F.lit(total).cast("bigint").alias("total"),
    )


def finalize(spark: SparkSession, sink: str, drop_duplicates: bool = True) -> DataFrame:
    """Output rows of a finished or stopped stream; duplicates removed on demand (ST4)."""
    rows = spark.read.parquet(sink).withColumn("products", F.lit(""))
    if drop_duplicates:
        rows = deduplicate(rows, ["page_id"])
    return to_output(rows)
