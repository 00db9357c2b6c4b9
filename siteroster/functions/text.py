"""Small Column helpers shared by all rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters str.strip() removes; Spark's trim() alone only removes blanks.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


_SEPARATOR = "\x1f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def first_where(values: Column, test: Callable[[Column], Column]) -> Column:
    return first(F.filter(values, test))


def present(values: Column) -> Column:
    """Array without nulls and empty strings."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def string_array(values: Iterable[str]) -> Column:
    """Constant array; built from one literal and folded when the plan is optimized."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_SEPARATOR.join(values)), _SEPARATOR)


def contains_any(c: Column, parts: Iterable[str]) -> Column:
    """True when the text contains any of the given parts, each taken literally."""
    return F.exists(string_array(parts), lambda p: c.contains(p))


def count_contained(c: Column, parts: Iterable[str]) -> Column:
    """How many of the given parts the text contains."""
    return F.size(F.filter(string_array(parts), lambda p: c.contains(p)))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def words(c: Column) -> Column:
    """Whitespace-separated words."""
    return present(F.split(c, r"(?U)\s+"))


def quote_regex(text: str) -> str:
    """Literal text as a Java regular expression."""
    return "".join("\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in text)


def matches_fully(c: Column, pattern: str) -> Column:
    return c.rlike(rf"^(?:{pattern})\z")
