"""Gap filling by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster.functions.text import first_where, let, strip
from siteroster.functions.urls import is_site_url, site_root
from siteroster.operators.filters import CONTACT_FIELDS, any_missing
from siteroster.operators.html import link_array

PLACE_FIELDS = ["email", "phone", "country", "city", "state"]
MODEL_FIELDS = ["country", "state", "city", "phone", "email", "company_name", "products"]
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def subpage_link(keywords: Sequence[str]) -> Column:
    """Link of a parsed page to its contact (or about) page, or null.

    Per keyword, the first link whose own first text holds it; then per
    keyword, the first link whose address holds it.  A pattern whose first
    link is not an absolute site URL yields nothing.
    """

    def search(links: Column) -> Column:
        def by_text(word: str) -> Column:
            return first_where(
                links,
                lambda a: F.translate(a["first_text"], _ASCII_UPPER, _ASCII_LOWER).contains(word),
            )

        def by_href(word: str) -> Column:
            return first_where(
                links,
                lambda a: a["href"].contains(word.replace(" ", ""))
                | a["href"].contains(word.replace(" ", "-")),
            )

        lower = [k.lower() for k in keywords]
        hits = [by_text(k) for k in lower] + [by_href(k) for k in lower]
        hrefs = F.array(*[hit["href"] for hit in hits])
        return first_where(hrefs, lambda h: F.coalesce(is_site_url(h), F.lit(False)))

    if not keywords:
        return F.lit(None).cast("string")
    return let(link_array(), search)


def find_subpage(parsed: DataFrame, keywords: Sequence[str]) -> DataFrame:
    return parsed.select("page_id", "url", subpage_link(keywords).alias("subpage_url"))


def keyword_slugs(keywords: Sequence[str]) -> list[str]:
    """Path names under which a keyword page may lie."""
    return [k.lower().replace(" ", "-").replace("_", "-") for k in keywords]


def probe_table(known: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``root → probe_url`` for sites that have a page at one of the keyword paths.

    Built from the known URLs, not by trying every site with every keyword: a
    narrow filter keeps the few matching URLs and one small aggregate remains.
    """
    slugs = keyword_slugs(keywords)
    order = F.array(*[F.lit(s) for s in slugs])
    root = site_root("url")
    slug = F.when(F.col("url").startswith(root), F.col("url").substr(F.length(root) + 2, F.length("url")))
    return (
        known.select("url", root.alias("root"), slug.alias("slug"))
        .where(F.col("slug").isin(slugs) & (F.col("url") == F.concat("root", F.lit("/"), "slug")))
        .groupBy("root")
        .agg(F.min_by("url", F.array_position(order, F.col("slug"))).alias("probe_url"))
    )


def left_lookup(df: DataFrame, table: DataFrame, key: Column, table_key: str) -> DataFrame:
    """Left join to a table with one row per key.

    Rows without a key get one of their own that matches nothing, so they
    spread over all tasks instead of meeting in one; a hot key sits only on
    the left side and is split by the adaptive skew join.
    """
    keyed = df.withColumn(
        "_key", F.coalesce(key, F.concat(F.lit("\u0000"), F.col("page_id").cast("string")))
    )
    other = table.withColumnRenamed(table_key, "_key")
    return keyed.join(other, "_key", "left").drop("_key")


def probe_subpage(sites: DataFrame, keywords: Sequence[str], known: DataFrame) -> DataFrame:
    """First ``{root}/{keyword}`` that is a known page, per site; null if none."""
    return left_lookup(sites, probe_table(known, keywords), site_root("url"), "root")


def fill_missing(df: DataFrame, source: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Fill null cells of ``df`` from the given columns where ``when`` holds."""
    gate = F.lit(True) if when is None else when
    return df.withColumns(
        {
            name: F.when(F.col(name).isNull() & gate, value).otherwise(F.col(name))
            for name, value in source.items()
        }
    )


def fill_from_page(df: DataFrame, prefix: str, visited: Column) -> DataFrame:
    """Take missing fields from the joined page columns; person and position together."""
    source = {name: F.col(prefix + name) for name in PLACE_FIELDS}
    nobody = F.col("contact_person").isNull()
    person, position = F.col(prefix + "contact_person"), F.col(prefix + "position")
    take = visited & nobody & person.isNotNull()
    return fill_missing(df, source, visited).withColumns(
        {
            "contact_person": F.when(take, person).otherwise(F.col("contact_person")),
            "position": F.when(take, position).otherwise(F.col("position")),
        }
    )


def lacks_reach() -> Column:
    """E-mail or phone missing: the reason to look at another page."""
    return any_missing(["email", "phone"])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def fill_from_pages(sites: DataFrame, extracted: DataFrame) -> DataFrame:
    """Staged fill (J3): the contact page where e-mail or phone is missing, then
    the about page where one still is.

    ``sites`` holds the contact fields plus ``contact_url`` and ``about_url``
    (the about link of the home page); ``extracted`` has one row per URL with
    the same fields and ``about_link``.  Once a contact page was read, its own
    about link counts instead of the home page's.
    """
    first_pass = left_lookup(
        sites, prefixed(extracted, "c_"), F.when(lacks_reach(), F.col("contact_url")), "c_url"
    )
    visited = F.col("c_page_id").isNotNull()
    step = fill_from_page(first_pass, "c_", visited)
    about = F.when(visited, F.col("c_about_link")).otherwise(F.col("about_url"))
    second_pass = left_lookup(
        step, prefixed(extracted, "a_"), F.when(lacks_reach(), about), "a_url"
    )
    done = fill_from_page(second_pass, "a_", F.col("a_page_id").isNotNull())
    return done.select(sites.columns)


def model_values(prefix: str = "m_") -> dict[str, Column]:
    """Offered values: trimmed, blanks dropped.  Products are never missing, so never filled."""
    return {
        name: F.nullif(strip(F.col(prefix + name)), F.lit(""))
        for name in MODEL_FIELDS
        if name != "products"
    }


def offered_fields(model: DataFrame) -> DataFrame:
    """One row per ``page_id`` of a prediction table, its fields under ``m_``.

    Of repeated predictions the first by their values counts, nulls last.
    """
    names = [n for n in MODEL_FIELDS if n != "products"]
    order = F.struct(*[c for n in names for c in (F.col(n).isNull(), F.col(n))])
    first = model.groupBy("page_id").agg(F.min_by(F.struct(*names), order).alias("first"))
    return first.select("page_id", *[F.col(f"first.{n}").alias("m_" + n) for n in names])


def fill_from_model(df: DataFrame, model: DataFrame) -> DataFrame:
    """Fill missing fields of rows with contact gaps from a prediction table keyed by ``page_id``."""
    joined = df.join(offered_fields(model), "page_id", "left").withColumn("_gap", any_missing(CONTACT_FIELDS))
    return fill_missing(joined, model_values(), F.col("_gap")).select(df.columns)


#: Leading digits of a number by which calling prefixes are looked up.
HEAD_DIGITS = 4


def prefix_dimension(prefixes: DataFrame) -> DataFrame:
    """``digits, owners``: the countries of each calling prefix, of any number of digits."""
    digits = F.regexp_replace("prefix", "[^0-9]", "")
    return (
        prefixes.select(digits.alias("digits"), "country")
        .where((F.length("digits") > 0) & F.col("country").isNotNull())
        .groupBy("digits")
        .agg(F.collect_set("country").alias("owners"))
    )


def prefix_lookup(prefixes: DataFrame) -> DataFrame:
    """One row per head of a number: ``head, owners, longer``.

    A head is the first ``HEAD_DIGITS`` digits, or a whole shorter number. ``owners``
    are those of the longest prefix that lies in the head; ``longer`` are the
    prefixes beyond it, longest first. Short prefixes are written out for all heads
    they cover, at most 11,110 in number, so any number of prefixes of any length
    takes a single equality lookup and nothing passes through the driver.
    """
    dimension = prefix_dimension(prefixes)
    size, n = F.length("digits"), F.lit(HEAD_DIGITS)
    covered = F.flatten(F.transform(F.sequence(size, n), lambda to: F.transform(
        F.sequence(F.lit(0), F.pow(F.lit(10), to - size).cast("int") - 1),
        lambda i: F.concat("digits", F.when(to > size, F.lpad(i.cast("string"), to - size, "0")).otherwise("")))))
    heads = F.when(size <= n, covered).otherwise(F.array(F.left("digits", n)))
    written = dimension.withColumn("head", F.explode(heads))
    prefix = F.struct((-size).alias("order"), "digits", "owners")
    return written.groupBy("head").agg(
        F.max_by("owners", F.when(size <= n, size)).alias("owners"),
        F.array_sort(F.collect_list(F.when(size > n, prefix))).alias("longer"))


def check_phone_country(df: DataFrame, prefixes: DataFrame, when: Column | None = None) -> DataFrame:
    """Replace a known country by the one an international phone number belongs to.

    The longest matching prefix decides.  A country that is one of its owners
    stays; so does any country where several owners are possible, and where the
    number does not start with ``+``.
    """
    return with_prefix_country(df, prefix_lookup(prefixes), when)


def with_prefix_country(df: DataFrame, lookup: DataFrame, when: Column | None = None) -> DataFrame:
    """``check_phone_country`` with a ``prefix_lookup`` that was made before."""
    number = F.trim("phone")
    digits = F.when(number.startswith("+"), F.regexp_replace(number, "[^0-9]", ""))
    head = F.when(F.length(digits) > 0, F.left(digits, F.lit(HEAD_DIGITS)))
    out = left_lookup(df, lookup.select("head", F.col("owners").alias("_owners"), F.col("longer").alias("_longer")), head, "head")
    longest = first_where(F.col("_longer"), lambda p: digits.startswith(p["digits"]))
    owners = F.coalesce(longest["owners"], F.col("_owners"))
    gate = F.lit(True) if when is None else when
    other = F.col("phone").isNotNull() & F.col("country").isNotNull() & gate & (
        F.size(owners) == 1) & ~F.array_contains(owners, F.col("country"))
    return out.withColumn(
        "country", F.when(other, F.get(owners, F.lit(0))).otherwise(F.col("country"))
    ).select(df.columns)
