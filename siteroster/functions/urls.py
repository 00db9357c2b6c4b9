"""URL rules (X4, X5, X6, X11 and URL predicates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.text import capitalize, col, contains_any, first_where, let, present

_SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def _clean(url: Column) -> Column:
    """URL without leading control characters, tabs and newlines."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)


def netloc_or_path(url: Column | str) -> Column:
    """Authority part (user and port included), else the path."""

    def split(u: Column) -> Column:
        return F.coalesce(
            F.nullif(netloc(u), F.lit("")),
            F.regexp_extract(u, _SCHEME + r"(?://[^/?#]*)?([^?#;]*)", 1),
        )

    return let(_clean(col(url)), split)


def hostname(url: Column | str) -> Column:
    """Lower-case host without user, port and brackets; '' when there is none."""
    return F.lower(
        F.regexp_extract(netloc(_clean(col(url))), r"^(?:.*@)?(?:\[([^\]]*)\].*|([^:]*).*)$", 2)
    )


def site_root(url: Column | str) -> Column:
    """``scheme://host`` of an http(s) URL, else null."""
    return F.nullif(F.regexp_extract(col(url), r"^(https?://[^/\n]+)", 1), F.lit(""))


def extract_domain(url: Column | str) -> Column:
    """Host used as the identity of a site: one leading ``www.`` (lower case
    only) and everything from the first colon on removed, then lower-cased."""
    place = netloc_or_path(url)
    broken = netloc(col(url)).contains("[") != netloc(col(url)).contains("]")
    return F.when(broken, F.btrim(F.lower(col(url)), F.lit("/"))).otherwise(
        F.lower(F.substring_index(F.regexp_replace(place, r"^www\.", ""), ":", 1))
    )


def _last_label(labels: Column, skip: Sequence[str]) -> Column:
    return first_where(F.reverse(labels), lambda p: ~p.isin(list(skip)) & (F.length(p) >= 3))


def domain_company_name(url: Column | str) -> Column:
    """Company name spelled from the host, e.g. ``med4you.co.za`` → ``Med 4 You``; null if none."""

    def spell(label: Column) -> Column:
        runs = F.regexp_extract_all(label, F.lit(r"[a-z]+|\d+"), F.lit(0))
        return F.when(
            F.size(runs) > 1, F.array_join(F.transform(runs, capitalize), " ")
        ).otherwise(capitalize(label))

    def choose(labels: Column) -> Column:
        head = F.get(labels, F.lit(0))
        return F.coalesce(
            _last_label(labels, fv.DOMAIN_SKIP_LABELS), F.when(F.length(head) >= 3, head)
        )

    host = F.replace(F.lower(netloc_or_path(url)), F.lit("www."), F.lit(""))
    return let(let(present(F.split(host, r"\.")), choose), spell)


def domain_fallback_name(url: Column | str) -> Column:
    """Plainer host name used when no company name was found at all."""
    host = F.regexp_replace(F.lower(netloc_or_path(url)), r"^www\.|/\z", "")

    def choose(labels: Column) -> Column:
        return F.coalesce(
            capitalize(_last_label(labels, fv.FALLBACK_SKIP_LABELS)),
            capitalize(F.get(labels, F.lit(0))),
        )

    return F.coalesce(let(present(F.split(host, r"\.")), choose), col(url))


def query_slug(c: Column | str) -> Column:
    slug = F.btrim(F.regexp_replace(col(c), "[^a-zA-Z0-9]+", "-"), F.lit("-"))
    return F.left(F.lower(slug), F.lit(80))


def is_http(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def is_site_url(url: Column | str) -> Column:
    """http(s) and not on a social network (judged by the last two host labels)."""
    u = col(url)
    tail = F.regexp_extract(hostname(u), r"([^.]*\.[^.]*)$", 1)
    return is_http(u) & ~tail.isin(fv.SOCIAL_DOMAINS)


def is_visit_url(url: Column | str) -> Column:
    """Worth visiting: http(s), no search page, no social profile, no ``.pdf``."""
    u = col(url)
    return (
        is_http(u)
        & ~u.contains("google.com/search")
        & ~u.rlike(fv.SOCIAL_VISIT_PATTERN)
        & ~u.endswith(".pdf")
    )


def is_result_url(url: Column | str, excluded: Sequence[str] = ()) -> Column:
    """No search-engine or video domain and none of the excluded parts."""
    return ~contains_any(F.lower(col(url)), [*fv.SEARCH_DOMAINS, *excluded])


def quote_plus(c: Column) -> Column:
    """Form encoding; Java's encoder differs on ``~`` and ``*``."""
    encoded = F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))
