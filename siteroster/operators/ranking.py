"""First-per-key operators (D1–D3): ``merge_results``, ``first_valid``, ``dedup_domain``.

``row_number() = 1`` is planned with a map-side group limit, so a key that
holds a third of the rows still sends one row per input task to the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteroster.functions.urls import extract_domain


def first_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]
) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def merge_results(
    results: DataFrame, order: Sequence[str] = ("query_pos", "rank")
) -> DataFrame:
    """Union of result lists with the first row per title kept."""
    return first_per_key(results, ["title"], list(order))


def first_valid(
    candidates: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value"
) -> DataFrame:
    """Lowest valid (non-null) candidate per key; one shuffle with map-side combine."""
    usable = F.col(value).isNotNull()
    return candidates.where(usable).groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(*order)).alias(value)
    )


def dedup_domain(df: DataFrame, order: Sequence[str], url: str = "url") -> DataFrame:
    """First row per site; rows without URL count as one site."""
    domain = F.coalesce(extract_domain(F.col(url)), F.lit(""))
    return first_per_key(df.withColumn("_domain", domain), ["_domain"], order).drop("_domain")
