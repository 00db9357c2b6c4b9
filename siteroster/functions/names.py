"""Company and person name rules (X7, X8) and roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.text import col, let, matches_fully, string_array, strip, words

ROLE_PATTERN = rf"(?U)\b((?i:{fv.ROLE_TITLES_PATTERN}))\b"
NAME_IN_TEXT = rf"(?U)\b{fv.NAME_PATTERN}\b"


def clean_company_name(c: Column | str) -> Column:
    """Trimmed company name, or null when it cannot be one."""

    def check(name: Column) -> Column:
        return F.when(
            F.length(name).between(3, 100)
            & ~name.rlike(f"(?d){fv.TEMPLATE_PATTERN}")
            & ~name.contains("@")
            & (F.size(words(name)) <= 10)
            & ~F.lower(name).isin(fv.STOCK_IMAGE_ALTS)
            & ~matches_fully(F.btrim(name, F.lit(".")), fv.BARE_DOMAIN_PATTERN)
            & ~(name.contains("_") & ~name.contains(" ")),
            name,
        )

    return let(strip(col(c)), check)


def is_person_name(c: Column | str, non_person_words: Sequence[str] = ()) -> Column:
    """2–4 capitalised words of 5–50 characters that do not look like anything else."""
    name = col(c)
    banned = string_array([*fv.NAME_SKIP_WORDS, *fv.COMPANY_WORDS, *non_person_words])
    noise = string_array(fv.NOISE_WORDS)

    def check_words(parts: Column) -> Column:
        share = F.size(F.filter(parts, lambda w: F.array_contains(noise, w))) / F.size(parts)
        return ~F.arrays_overlap(parts, banned) & (share < fv.NOISE_SHARE)

    shaped = (
        F.length(name).between(5, 50)
        & name.contains(" ")
        & ~name.contains("  ")
        & matches_fully(name, rf"(?U){fv.NAME_PATTERN}")
        & ~name.rlike(ROLE_PATTERN)
    )
    return F.coalesce(F.when(shaped, let(words(name), check_words)), F.lit(False))


def role_in(c: Column | str) -> Column:
    """First role title in the text as written, or null."""
    return F.nullif(F.regexp_extract(col(c), ROLE_PATTERN, 1), F.lit(""))


def normalize_role(c: Column | str) -> Column:
    """Canonical spelling of a known role, other texts unchanged."""
    known = F.map_from_arrays(
        string_array(fv.ROLE_CANONICAL), string_array(fv.ROLE_CANONICAL.values())
    )
    role = col(c)
    return F.coalesce(F.try_element_at(known, F.lower(role)), role)


def extract_role(line: Column | str, name: Column | str) -> Column:
    """Role on the line of a name, or null."""
    rest = strip(F.replace(col(line), col(name), F.lit("")))
    rest = strip(F.ltrim(rest, F.lit(fv.ROLE_LEAD_CHARS)))
    return normalize_role(role_in(rest))


def is_valid_role(c: Column | str) -> Column:
    return F.coalesce(F.length(col(c)).between(1, fv.ROLE_MAX_CHARS - 1), F.lit(False))
