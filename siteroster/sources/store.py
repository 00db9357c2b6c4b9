"""A page table laid out for visits, and the test of wanted URLs inside a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the wanted-URL bitmap: a fixed size, whatever the number of URLs.
WANTED_BITS = 1 << 26


def write_page_store(pages: DataFrame, name: str, buckets: int = 512) -> None:
    """Save ``page_id, url, html`` as the table ``name``, dealt to buckets by URL and sorted by it in each.

    Every visit of such a table joins by URL and finds its pages where they lie: only
    the list of wanted URLs is shuffled, never the HTML. At 100 TB take tens of
    thousands of buckets, so that a bucket stays a few gigabytes. Pages without URL
    are left out, as no visit finds them.
    """
    rows = pages.select("page_id", "url", "html").where("url is not null").repartition(buckets, "url")
    rows.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").format("parquet").saveAsTable(name)


def read_page_store(spark: SparkSession, name: str) -> DataFrame:
    """The stored pages; joins by URL use the buckets."""
    return spark.table(name).select("page_id", "url", "html")


def _places(url: Column) -> tuple[Column, Column]:
    place = F.pmod(F.xxhash64(url), F.lit(WANTED_BITS))
    return F.floor(place / 64).cast("int"), (place % 64).cast("int")


def may_be_wanted(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The pages whose URL may be one of ``urls``: all that are, and few others.

    A bitmap of ``WANTED_BITS`` bits over the URLs' hashes is built by an aggregate and
    tested beside the scan, before any shuffle. It has at most a million words, so it
    may always be sent to all tasks.
    """
    word, bit = _places(F.col("url"))
    bitmap = urls.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit")).groupBy(
        "_word").agg(F.bit_or("_bit").alias("_bits"))
    own_word, own_bit = _places(pages["url"])
    set_there = F.when(F.getbit(F.col("_bits"), own_bit) == 1, True).otherwise(False)
    return pages.join(F.broadcast(bitmap), (own_word == F.col("_word")) & set_there, "left_semi")


def is_broadcastable(table: DataFrame) -> bool:
    """Whether the optimizer sends a table to all tasks by its known size."""
    spark = table.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit
