"""Word lists given as text files."""

from __future__ import annotations

from pyspark.sql import SparkSession

MAX_WORDS = 10_000


def read_word_list(spark: SparkSession, path: str) -> tuple[str, ...]:
    """One word per line; a vocabulary is configuration, so its size is checked."""
    rows = spark.read.text(path).where("trim(value) <> ''").limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words in {path}")
    return tuple(row.value.strip() for row in rows)
