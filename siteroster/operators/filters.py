"""Row filters and page judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.text import contains_any, count_contained, let, strip
from siteroster.functions.urls import (
    is_result_url,
    is_site_url,
    is_visit_url,
    quote_plus,
)
from siteroster.operators.html import has_class, single_string, where_nodes

CONTACT_FIELDS = ["email", "phone", "country", "state", "city"]


def filter_search_urls(df: DataFrame, excluded: Sequence[str] = (), url: str = "url") -> DataFrame:
    return df.where(is_result_url(url, excluded))


def filter_visit_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(is_visit_url(url))


def filter_site_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(is_site_url(url))


def drop_generic_titles(df: DataFrame, title: str = "title") -> DataFrame:
    return df.where(~F.lower(strip(F.col(title))).isin(fv.GENERIC_TITLES))


def relevance_score(text: Column, categories: Sequence[str]) -> Column:
    """Categories plus manufacturing terms named in the text; nested terms count each."""
    terms = [c.lower() for c in categories] + fv.MAKER_TERMS
    return let(F.lower(text), lambda t: count_contained(t, terms))


def relevance(
    df: DataFrame, categories: Sequence[str], text: str = "text", minimum: int = 2
) -> DataFrame:
    scored = df.withColumn("score", relevance_score(F.col(text), categories))
    return scored.where(F.col("score") >= minimum)


def shop_text_score(text: Column, indicators: Sequence[str]) -> Column:
    return let(F.lower(text), lambda t: count_contained(t, [i.lower() for i in indicators]))


def shop_element_count() -> Column:
    """Cart-like links, buttons and boxes plus product grids of a parsed page."""
    carts = where_nodes(
        lambda n: n["tag"].isin("a", "button", "div")
        & F.coalesce(single_string(n).rlike(f"(?iu){fv.CART_PATTERN}"), F.lit(False))
    )

    def is_grid(n: Column) -> Column:
        hit = F.lit(False)
        for name in fv.GRID_CLASSES:
            hit = hit | has_class(n, name)
        return n["tag"].isin("div", "ul") & F.coalesce(hit, F.lit(False))

    return F.size(carts) + F.size(where_nodes(is_grid))


def is_shop(text: Column, indicators: Sequence[str]) -> Column:
    return (shop_text_score(text, indicators) >= 6) & (shop_element_count() >= 3)


def flag_ecommerce(texts: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """``texts`` is a parsed page table with ``text``."""
    return texts.select(
        "page_id",
        shop_text_score(F.col("text"), indicators).alias("text_score"),
        shop_element_count().alias("element_count"),
        is_shop(F.col("text"), indicators).alias("is_shop"),
    )


def is_blocked(html: Column) -> Column:
    """Interstitial page.  A frame source, class or id naming a captcha is part
    of the page source, so the phrase test over the source covers them."""
    return let(F.lower(html), lambda h: contains_any(h, fv.BLOCKED_PHRASES))


def flag_blocked_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("is_blocked", is_blocked(F.col("html")))


def any_missing(fields: Sequence[str], prefix: str = "") -> Column:
    gap = F.lit(False)
    for name in fields:
        gap = gap | F.col(prefix + name).isNull()
    return gap


def has_gaps(df: DataFrame) -> DataFrame:
    """Rows lacking any of e-mail, phone, country, state, city."""
    return df.where(any_missing(CONTACT_FIELDS))


def search_frontier(queries: DataFrame, attempts: int, pages: int) -> DataFrame:
    """URLs to fetch per query: ``(query_pos, query)`` × attempt × result page.

    Attempt 0 is the plain query, attempt 1 only opens the home page, later
    ones add a suffix word, cycling.
    """
    suffixes = F.array(*[F.lit(s) for s in fv.SEARCH_SUFFIXES])
    attempt, page = F.col("attempt"), F.col("page_num")
    suffix = F.get(suffixes, F.pmod(attempt - 2, F.lit(len(fv.SEARCH_SUFFIXES))))
    text = F.when(attempt == 0, F.col("query")).otherwise(
        F.concat(F.col("query"), F.lit(" "), suffix)
    )
    start = F.when(page > 1, F.concat(F.lit("&start="), (page - 1) * 10)).otherwise("")
    return (
        queries.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
        .withColumn(
            "page_num",
            F.explode(F.sequence(F.lit(1), F.when(attempt == 1, 1).otherwise(pages))),
        )
        .withColumn(
            "url",
            F.when(attempt == 1, F.lit(fv.SEARCH_HOME)).otherwise(
                F.concat(F.lit(fv.SEARCH_HOME + "/search?q="), quote_plus(text), start)
            ),
        )
    )


