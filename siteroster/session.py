"""Session settings the plans were tuned with, and materialised cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # One hot key on the many side of a lookup join is split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HTML rows are wide: small Arrow batches keep Python workers flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    # Long rule expressions are built call by call; skip the call-site capture.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Stages of few bytes may still be much work: let them keep all cores busy. Large stages are not affected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    # Lets "first k per key" stay a map-side limit in later dedup rounds.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("siteroster")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Keyed state of streams, one entry per key and map key: held in RocksDB, change logs in the checkpoint folder.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def state_settings(partitions: int | None) -> dict[str, str]:
    """Settings to start a stateful stream with; the number of its state's partitions then stays for the checkpoint's life."""
    return STATE_STORE if partitions is None else {**STATE_STORE, "spark.sql.shuffle.partitions": str(partitions)}


@contextmanager
def session_settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings for the plans and streams that are started inside; the session's own ones come back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


#: Bytes up to which a scan of few splits may be dealt to all cores.
SPREAD_BYTES = 64 << 20


def spread(scan: DataFrame) -> DataFrame:
    """Deal a small scan (by the optimizer's size) of few splits to all cores for CPU-bound work.

    A larger table is returned as it is: its splits follow
    ``spark.sql.files.maxPartitionBytes``, and moving its HTML would cost more.
    """
    spark = scan.sparkSession
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return scan.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else scan


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siteroster-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table under the checkpoint folder and read it back.

    Cuts the lineage with files that survive lost executors, and unlike a
    row-format checkpoint stays columnar: later readers prune columns, and the
    optimizer sees real sizes when it picks a join strategy.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
