"""Counts and profiles (A1–A4)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.text import strip
from siteroster.operators.filters import CONTACT_FIELDS


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: longest text (header included), display width, missing cells.

    One aggregate over the rows; only its single result row is unpivoted.
    """
    facts = []
    for name in df.columns:
        cell = F.col(f"`{name}`").cast("string")
        longest = F.greatest(F.coalesce(F.max(F.length(cell)), F.lit(0)), F.lit(len(name)))
        missing = F.count_if(strip(cell) == fv.NOT_FOUND)
        facts.append(
            F.struct(
                F.lit(name).alias("column_name"),
                longest.alias("max_len"),
                F.least(longest + 3, F.lit(60)).alias("width"),
                missing.alias("not_found"),
            )
        )
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def contact_completeness(df: DataFrame) -> DataFrame:
    """Rows, rows with any contact field, and filled cells per field."""
    found = F.coalesce(*[F.col(c) for c in CONTACT_FIELDS]).isNotNull()
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(found).alias("n_found"),
        *[F.count(c).alias(f"n_{c}") for c in CONTACT_FIELDS],
    )


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count per named stage, in the order given."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(i).alias("stage_pos"), F.lit(name).alias("stage"), "n_rows"
        )
        for i, (name, df) in enumerate(stages.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def run_funnel(source: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Row count after each named step, in one run of the whole chain of steps.

    The counts are observed on the running plan, so the source is read once and
    no step is worked out again for a later one. The first step is given the
    source. The counts, one a step, are the only thing that reaches the driver.
    """
    rows, seen = source, {}
    for name, step in steps.items():
        seen[name] = Observation()
        rows = step(rows).observe(seen[name], F.count(F.lit(1)).alias("n_rows"))
    rows.write.format("noop").mode("overwrite").save()
    facts = [(i, name, metrics.get["n_rows"]) for i, (name, metrics) in enumerate(seen.items())]
    return source.sparkSession.createDataFrame(facts, "stage_pos int, stage string, n_rows bigint")


def results_per_query(results: DataFrame) -> DataFrame:
    return results.groupBy("query_slug").agg(F.count("*").alias("n_results"))
