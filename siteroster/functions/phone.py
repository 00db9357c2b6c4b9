"""Phone rules."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster.functions.text import col, first_where, let, string_array


def prefix_table(prefixes: Sequence[str]) -> Column:
    """Literal array of (digits, prefix), longest digits first."""
    pairs = [(re.sub(r"\D", "", p), p) for p in prefixes]
    pairs = sorted((p for p in pairs if p[0]), key=lambda p: -len(p[0]))
    return F.arrays_zip(
        string_array(d for d, _ in pairs).alias("digits"),
        string_array(p for _, p in pairs).alias("prefix"),
    )


def normalize_phone(c: Column | str, prefixes: Sequence[str]) -> Column:
    """Compact form of a phone number, or null.

    A known prefix is recognised when the compact number starts with the
    prefix *digits*, so numbers written with a leading ``+`` keep it unsplit.
    """
    table = prefix_table(prefixes)

    def check(phone: Column) -> Column:
        compact, digits = phone["compact"], phone["digits"]
        n = F.length(digits)
        repeated = F.replace(digits, F.substring(digits, 1, 1), F.lit("")) == ""
        usable = compact.rlike(r"(?U)\d\z") & n.between(7, 14) & ~repeated

        def apply_prefix(hit: Column) -> Column:
            rest = compact.substr(F.length(hit["digits"]) + 1, F.length(compact))
            return F.when(
                hit.isNotNull(),
                F.when(rest != "", F.concat(hit["prefix"], F.lit(" "), rest)).otherwise(hit["prefix"]),
            ).when(n >= 9, compact)

        known = first_where(table, lambda p: compact.startswith(p["digits"]))
        return F.when(usable, let(known, apply_prefix))

    compact = F.regexp_replace(col(c), r"(?U)[\s\-().]", "")
    parts = let(
        compact,
        lambda x: F.struct(x.alias("compact"), F.regexp_replace(x, r"(?U)\D", "").alias("digits")),
    )
    return let(parts, check)
