"""E-mail rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.text import capitalize, col, contains_any, let, matches_fully, string_array, strip

# Same hits as the plain pattern, but only tried where a run of mailbox
# characters begins (or right after the previous hit): linear, not quadratic,
# on long runs such as inlined data.
_SCAN = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def all_emails(c: Column | str) -> Column:
    """Every address in the text, in order, as written."""
    return F.regexp_extract_all(col(c), F.lit(_SCAN), F.lit(0))


def normalize_email(c: Column | str) -> Column:
    """Trimmed lower-case address, or null for placeholders and image names."""

    def check(email: Column) -> Column:
        domain = F.substring_index(email, "@", -1)
        image = F.exists(string_array(fv.IMAGE_SUFFIXES), lambda s: email.endswith(s))
        return F.when(
            matches_fully(email, fv.EMAIL_PATTERN)
            & ~domain.isin(fv.PLACEHOLDER_DOMAINS)
            & ~image
            & ~contains_any(email, fv.RETINA_MARKS),
            email,
        )

    return let(F.lower(strip(col(c))), check)


def name_from_email(c: Column | str) -> Column:
    """``jane.doe@…`` → ``Jane Doe``; null for role mailboxes and other shapes."""

    def spell(local: Column) -> Column:
        role = F.exists(string_array(fv.ROLE_MAILBOXES), lambda m: local.startswith(m))
        return F.when(
            local.rlike(r"^[a-z][a-zA-Z]*(?:\.[a-z][a-zA-Z]*)+\z") & ~role,
            F.array_join(F.transform(F.split(local, r"\."), capitalize), " "),
        )

    return let(F.substring_index(col(c), "@", 1), spell)
