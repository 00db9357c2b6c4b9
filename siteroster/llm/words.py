"""Words and lines as Column expressions, and cut points, shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the contracts: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text that is not null."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, unlike ``lower``, whose result differs between engines."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def lines(text: Column) -> Column:
    """The ``\\n``-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
