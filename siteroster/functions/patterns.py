"""User patterns, checked when a plan is built."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession


def pattern_groups(pattern: str) -> int:
    """Number of groups of a pattern, by the engine that will run it.

    A pattern that is no valid regular expression of the executors is an error
    here, before any job starts.
    """
    java = SparkSession.active().sparkContext._jvm.java.util.regex.Pattern
    try:
        return java.compile(pattern).matcher("").groupCount()
    except IllegalArgumentException as error:
        reason = str(error).splitlines()[0]
        raise ValueError(f"pattern {pattern!r} is not valid: {reason}") from None
