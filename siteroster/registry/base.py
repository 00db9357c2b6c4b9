"""Helpers of the query registry.

A registry entry is ``name: (query, sql)``: the query reads whole tables of a
data folder; the SQL is an independent statement of the same result, or None.
Expressions named ``*_RAW`` are plain SQL both engines understand; they vary
table columns so that every branch of a rule is met.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_values(values) -> str:
    """``(0, 'a'), (1, 'b'), …``"""
    return ", ".join(f"({i}, '" + v.replace("'", "''") + "')" for i, v in enumerate(values))


def choose(key: str, options: list[str]) -> str:
    """SQL CASE picking one of the options by ``key`` modulo their number."""
    arms = " ".join(f"when {i} then {option}" for i, option in enumerate(options[:-1]))
    return f"(case ({key}) % {len(options)} {arms} else {options[-1]} end)"
