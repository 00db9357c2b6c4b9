"""Search results and fetched pages in, directory out.

Pages are visited as in a browser session, but set-wise: home pages of all
usable results, then the contact pages of those still lacking an e-mail or a
phone, then about pages.  Each visit is a semi join of the page table with a
materialised URL list, so HTML that is not needed is never parsed, and the
optimizer broadcasts the list only when its real size allows; a larger list is
tested in the scan first.  Only compact rows take part in the joins and rankings
after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.config import DirectoryConfig
from siteroster.functions.names import clean_company_name
from siteroster.functions.urls import domain_company_name, domain_fallback_name, site_root
from siteroster.operators.company import page_company_name
from siteroster.operators.contact import products
from siteroster.operators.fill import (
    fill_from_page,
    fill_missing,
    lacks_reach,
    left_lookup,
    model_values,
    offered_fields,
    prefix_lookup,
    prefixed,
    probe_table,
    subpage_link,
    with_prefix_country,
    MODEL_FIELDS,
)
from siteroster.operators.filters import (
    CONTACT_FIELDS,
    any_missing,
    drop_generic_titles,
    filter_site_urls,
    filter_visit_urls,
    is_shop,
    relevance_score,
)
from siteroster.operators.ranking import first_per_key, merge_results
from siteroster.operators.similar import deduplicate
from siteroster.plans.contacts import contact_rows, read_parsed
from siteroster.session import materialize
from siteroster.sources.output import to_output
from siteroster.sources.store import is_broadcastable, may_be_wanted

ORDER = ["query_pos", "rank", "title"]


def wanted_sites(results: DataFrame) -> DataFrame:
    """Results worth a visit: first per title, no stock titles, no unusable URLs."""
    merged = merge_results(results, ["query_pos", "rank", "url"])
    return filter_site_urls(filter_visit_urls(drop_generic_titles(merged)))


def fetched_pages(pages: DataFrame) -> DataFrame:
    """``url, page_id`` of the pages that were fetched: the one scan that tests the HTML column for all visits."""
    return materialize(pages.where("html is not null").select("url", "page_id"), "fetched")


def visit(pages: DataFrame, urls: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """First fetched page, by ``page_id``, of every listed URL.

    The copy is chosen on the narrow columns of ``fetched`` (see ``fetched_pages``), so the
    filters that follow cannot prefer a later one, and the list that the HTML is
    joined with knows its size. A list that is too large to be sent to all tasks
    first leaves a bitmap in the scan, so only HTML that is likely wanted is
    shuffled; a page store (``sources.store``) is not shuffled at all.
    """
    fetched = fetched_pages(pages) if fetched is None else fetched
    first = fetched.join(urls.select("url").distinct(), "url", "left_semi")
    first = materialize(first.groupBy("url").agg(F.min("page_id").alias("_page")), "visits")
    rows = pages.where("html is not null")
    if not is_broadcastable(first):
        rows = may_be_wanted(rows, first)
    # the URL alone is the join's key, as it is the store's: an equality of ids would become a key beside it
    own, chosen = [F.coalesce(c, F.lit(-1).cast("bigint")) for c in (rows["page_id"], first["_page"])]
    return rows.join(first, (rows["url"] == first["url"]) & (own >= chosen) & (own <= chosen), "left_semi")


def _attach_model(rows: DataFrame, model: DataFrame | None) -> DataFrame:
    if model is None:
        names = [n for n in MODEL_FIELDS if n != "products"]
        return rows.withColumns({"m_" + n: F.lit(None).cast("string") for n in names})
    return rows.join(offered_fields(model), "page_id", "left")


def _model_step(
    df: DataFrame, prefix: str, visited: Column, prefixes: DataFrame | None
) -> DataFrame:
    """Predictions and the phone–country check (by a prefix lookup), for visited rows with gaps."""
    gap = df.withColumn("_gap", visited & any_missing(CONTACT_FIELDS))
    filled = fill_missing(gap, model_values(prefix), F.col("_gap"))
    if prefixes is not None:
        filled = with_prefix_country(filled, prefixes, F.col("_gap"))
    return filled.drop("_gap")


def home_rows(
    pages: DataFrame, sites: DataFrame, config: DirectoryConfig, model: DataFrame | None = None,
    fetched: DataFrame | None = None,
) -> DataFrame:
    """Home pages of the sites that are relevant and no shops, with all fields."""
    parsed = read_parsed(visit(pages, sites, fetched))
    fitting = parsed.withColumn(
        "score", relevance_score(F.col("text"), config.product_categories)
    ).where((F.col("score") >= 2) & ~is_shop(F.col("text"), config.ecommerce_indicators))
    named = F.array_join(products(F.col("text"), config.product_categories), ", ")
    rows = contact_rows(
        fitting,
        config,
        page_name=page_company_name(F.col("url")),
        products=named,
        contact_link=subpage_link(config.contact_keywords),
        about_link=subpage_link(fv.ABOUT_KEYWORDS),
    )
    return _attach_model(first_per_key(rows, ["url"], ["page_id"]), model)


def sub_rows(
    pages: DataFrame, urls: DataFrame, config: DirectoryConfig, model: DataFrame | None = None,
    fetched: DataFrame | None = None,
) -> DataFrame:
    """Contact or about pages at the given URLs, one row per URL."""
    parsed = read_parsed(visit(pages, urls, fetched))
    rows = contact_rows(parsed, config, about_link=subpage_link(fv.ABOUT_KEYWORDS))
    return _attach_model(first_per_key(rows, ["url"], ["page_id"]), model)


def site_contacts(
    sites: DataFrame,
    pages: DataFrame,
    config: DirectoryConfig,
    model: DataFrame | None = None,
    prefixes: DataFrame | None = None,
) -> DataFrame:
    """One filled row per usable site (before duplicates are removed)."""
    sites = materialize(sites, "sites")
    if prefixes is not None:
        prefixes = materialize(prefix_lookup(prefixes), "prefixes")
    fetched = fetched_pages(pages)
    homes = sites.join(home_rows(pages, sites, config, model, fetched), "url")
    host = domain_company_name(F.col("url"))
    homes = homes.withColumn(
        "company_name", F.coalesce("page_name", clean_company_name(F.col("title")), host)
    )
    known = pages.select("url")
    root = site_root("url")

    contact_probe = probe_table(known, config.contact_keywords) if config.contact_keywords else None
    step = homes.withColumn("contact_url", F.col("contact_link"))
    if contact_probe is not None:
        lookup = F.when(lacks_reach() & F.col("contact_link").isNull(), root)
        step = left_lookup(step, contact_probe, lookup, "root").withColumn(
            "contact_url", F.coalesce("contact_link", "probe_url")
        ).drop("probe_url")
    step = materialize(
        step.withColumn("contact_url", F.when(lacks_reach(), F.col("contact_url"))), "homes"
    )

    wanted = step.where("contact_url is not null").select(F.col("contact_url").alias("url"))
    contact = sub_rows(pages, wanted, config, model, fetched)
    step = left_lookup(step, prefixed(contact, "c_"), F.col("contact_url"), "c_url")
    visited = F.col("c_page_id").isNotNull()
    step = fill_from_page(step, "c_", visited)
    step = _model_step(step, "c_m_", visited, prefixes)

    link = F.when(visited, F.col("c_about_link")).otherwise(F.col("about_link"))
    step = step.withColumn("about_url", link)
    lookup = F.when(lacks_reach() & F.col("about_url").isNull(), root)
    step = left_lookup(step, probe_table(known, fv.ABOUT_KEYWORDS), lookup, "root")
    step = step.withColumn(
        "about_url", F.when(lacks_reach(), F.coalesce("about_url", "probe_url"))
    ).drop("probe_url", *["c_" + c for c in contact.columns])
    step = materialize(step, "contacts")

    wanted = step.where("about_url is not null").select(F.col("about_url").alias("url"))
    about = sub_rows(pages, wanted, config, model, fetched)
    step = left_lookup(step, prefixed(about, "a_"), F.col("about_url"), "a_url")
    visited = F.col("a_page_id").isNotNull()
    step = fill_from_page(step, "a_", visited)
    step = _model_step(step, "a_m_", visited, prefixes)

    step = _model_step(step, "m_", F.lit(True), prefixes)
    return step.select(
        *sites.columns, "page_id",
        F.coalesce("company_name", domain_fallback_name("url")).alias("company_name"),
        "contact_person", "position", "state", "city", "country", "phone", "email", "products",
    )


def build_directory(
    results: DataFrame,
    pages: DataFrame,
    config: DirectoryConfig,
    model: DataFrame | None = None,
    prefixes: DataFrame | None = None,
) -> DataFrame:
    """The ten output columns, one row per company, in result order.

    ``results``: ``query_pos, rank, title, url``; ``pages``: ``page_id, url, html``;
    ``model``: optional predictions per ``page_id``; ``prefixes``: optional
    ``prefix, country`` dimension.
    """
    rows = site_contacts(wanted_sites(results), pages, config, model, prefixes)
    unique = deduplicate(materialize(rows, "site-contacts"), ORDER)
    return to_output(unique.orderBy(*ORDER))


