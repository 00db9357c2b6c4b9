"""E-mail, phone, country, city, state and products of a parsed page.

Every function returns a Column over a row made by ``parse_pages`` and
``with_text``.  "First valid wins" is the order of array elements and of
``coalesce`` arguments, so later stages only run when earlier ones are empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.email import normalize_email
from siteroster.functions.patterns import pattern_groups
from siteroster.functions.phone import normalize_phone
from siteroster.functions.places import normalize_country
from siteroster.functions.text import (
    contains_any,
    first,
    first_where,
    let,
    present,
    quote_regex,
    string_array,
    strip,
)
from siteroster.operators.html import (
    all_nodes,
    class_matches,
    node_stripped,
    node_text,
    single_string,
    where_nodes,
)
from siteroster.operators.jsonld import place_in_items

def page_text() -> Column:
    return F.col("text")


def page_lines() -> Column:
    return F.col("lines")


def not_null(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def email(emails: Column | None = None) -> Column:
    """First acceptable address among the raw hits of the page."""
    hits = F.col("emails") if emails is None else emails
    return first(not_null(F.transform(hits, normalize_email)))


def phone(patterns: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Phone of a page.

    First pass: per pattern, all hits on lines with a phone word.  Second
    pass: per pattern, only its first hit in the whole text.  A pattern with
    several groups has no single hit and ends the search where it matches.
    """

    def hits(text: Column, pattern: str, groups: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(min(groups, 1)))
        return F.transform(found, lambda _: F.lit("")) if groups > 1 else F.transform(found, strip)

    def valid(hit: Column) -> Column:
        return F.when(hit == "", hit).otherwise(normalize_phone(hit, prefixes))

    def cascade(lines: Column) -> Column:
        stages = []
        for pattern in patterns:
            groups = pattern_groups(pattern)
            per_line = F.flatten(F.transform(lines, lambda ln: hits(ln, pattern, groups)))
            keep = per_line if groups > 1 else present(per_line)
            stages.append(first(not_null(F.transform(keep, valid))))
        for pattern in patterns:
            groups = pattern_groups(pattern)
            # regexp_extract stops at the first hit; a blank hit is no hit.
            if groups > 1:
                stages.append(F.when(page_text().rlike(f"(?U){pattern}"), F.lit("")))
            else:
                head = strip(F.regexp_extract(page_text(), f"(?U){pattern}", groups))
                stages.append(normalize_phone(head, prefixes))
        return F.nullif(F.coalesce(*stages), F.lit(""))

    if not patterns:
        return F.lit(None).cast("string")
    keyed = F.filter(page_lines(), lambda ln: contains_any(F.lower(ln), fv.PHONE_LINE_WORDS))
    return let(keyed, cascade)


def country_in(text: Column, countries: Sequence[str]) -> Column:
    """First country, in whitelist order, that stands as a word in the text."""
    if not countries:
        return F.lit(None).cast("string")
    word = r"(?iU)\b(?:{})\b"
    found = F.lit(None).cast("string")
    for name in reversed(list(countries)):
        spelled = normalize_country(F.lit(name), countries)
        found = F.when(text.rlike(word.format(quote_regex(name))), spelled).otherwise(found)
    any_name = "|".join(quote_regex(name) for name in countries)
    return F.when(text.rlike(word.format(any_name)), found)


def country(countries: Sequence[str], keywords: Sequence[str]) -> Column:
    """Country of a page (E3): the whole text, then the blocks around address labels.

    The second look only matters where joined strings hide a word boundary.
    """
    heads = [quote_regex(k.split(":")[0]) for k in keywords]
    label = "(?iu)" + "|".join(heads)
    labelled = where_nodes(
        lambda n: n["tag"].isin("p", "div", "span")
        & (n["block_id"] >= 0)
        & F.coalesce(single_string(n).rlike(label), F.lit(False))
    )
    blocks = F.array_distinct(F.transform(labelled, lambda n: n["block_id"]))
    nearby = F.transform(blocks, lambda b: country_in(node_text(F.get(all_nodes(), b)), countries))
    return F.coalesce(country_in(page_text(), countries), first(not_null(nearby)))


def _short(text: Column) -> Column:
    return F.length(text).between(1, fv.PLACE_MAX_CHARS - 1)


def _itemprop(name: str) -> Column:
    """A blank value is taken too; it ends the search without a result."""
    values = F.transform(
        where_nodes(lambda n: n["itemprop"] == name),
        lambda n: F.coalesce(F.nullif(n["content"], F.lit("")), node_stripped(n)),
    )
    return strip(first_where(values, _short))


def _by_class(pattern: str) -> Column:
    texts = F.transform(where_nodes(lambda n: class_matches(n, pattern)), node_stripped)
    return first_where(texts, _short)


def _labelled(word: str) -> Column:
    """``City: Name`` in the text; only the first mention of the label counts."""
    pattern = "(?iU)" + fv.LABELLED_PLACE_PATTERN.format(word=word)
    return let(
        strip(F.regexp_extract(page_text(), pattern, 1)),
        lambda name: F.when(name.rlike(r"^\p{Lu}"), name),
    )


def _place(itemprop: str, classes: list[str], words: list[str]) -> list[Column]:
    return [
        _itemprop(itemprop),
        *[_by_class(c) for c in classes],
        place_in_items(F.col("jsonld"), itemprop),
        *[_labelled(w) for w in words],
    ]


def _city_above_contact_line() -> Column:
    """``City, Country`` on one of the two lines before a contact line."""
    pattern = "(?U)" + fv.CITY_LINE_PATTERN.format(countries="|".join(fv.CITY_LINE_COUNTRIES))

    def look(i: Column) -> Column:
        above = F.transform(
            F.array(i - 2, i - 1),
            lambda j: F.when(j >= 0, F.regexp_extract(F.get(page_lines(), j), pattern, 1)),
        )
        return first(present(F.transform(above, strip)))

    spots = F.filter(
        F.transform(
            page_lines(), lambda ln, i: F.when(contains_any(F.lower(ln), fv.ADDRESS_LINE_WORDS), i)
        ),
        lambda i: i.isNotNull(),
    )
    return first(not_null(F.transform(spots, look)))


def city() -> Column:
    stages = _place("addressLocality", fv.CITY_CLASSES, fv.CITY_WORDS)
    return F.nullif(F.coalesce(*stages, _city_above_contact_line()), F.lit(""))


def state() -> Column:
    return F.nullif(
        F.coalesce(*_place("addressRegion", fv.STATE_CLASSES, fv.STATE_WORDS)), F.lit("")
    )


def products(text: Column, categories: Sequence[str]) -> Column:
    """Categories named in the text, in configured order, each once."""
    low = F.lower(text)
    named = string_array(dict.fromkeys(categories))
    return let(low, lambda t: F.filter(named, lambda c: t.contains(F.lower(c))))
