"""Country rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster.functions.text import col, first_where, let, string_array, strip


def normalize_country(c: Column | str, whitelist: Sequence[str]) -> Column:
    """Canonical spelling: equal ignoring case, else (over 3 characters) the
    first whitelist entry that is a prefix of the text or the other way round."""
    exact = string_array({name.lower(): name for name in whitelist}.values())
    ordered = string_array(whitelist)

    def pick(name: Column) -> Column:
        near = first_where(
            ordered, lambda c: F.lower(c).startswith(name) | name.startswith(F.lower(c))
        )
        return F.coalesce(
            first_where(exact, lambda c: F.lower(c) == name), F.when(F.length(name) > 3, near)
        )

    return let(F.lower(strip(col(c))), pick)
