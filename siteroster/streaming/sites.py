"""One filled row per site from a stream of pages, whatever batches its pages arrive in (ST1, ST4 with J3).

State is kept per site (domain) in the state store, one entry per page URL: the
compact fields of a page, never its HTML. Whenever pages of a site arrive, its
home pages look up their contact and about pages there, and a home page whose
partners changed is sent out with them; the fill itself is the batch rule. A home
page thus first appears as far as it is known and again with every page that
completes it; ``latest_sites`` keeps its last version. Home pages that do not fit
the product categories, and shops, send nothing.

Of several copies of a URL the first batch's counts, and in it the smallest
``page_id``. Links that lead to another site are not followed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siteroster import fixed_values as fv
from siteroster.config import DirectoryConfig
from siteroster.functions.urls import extract_domain, site_root
from siteroster.operators.company import company_name
from siteroster.operators.contact import products
from siteroster.operators.fill import PLACE_FIELDS, fill_from_page, keyword_slugs, lacks_reach, subpage_link
from siteroster.operators.filters import is_shop, relevance_score
from siteroster.operators.ranking import first_per_key
from siteroster.operators.similar import deduplicate
from siteroster.plans.contacts import contact_rows, read_parsed
from siteroster.session import session_settings, state_settings
from siteroster.sources.output import to_output
from siteroster.streaming.contacts import Progress, dealt, write_batch

PERSON_FIELDS = ["contact_person", "position"]
#: What a page gives to a home page, and what a home page keeps beside that.
PAGE_FIELDS = ["page_id", *PLACE_FIELDS, *PERSON_FIELDS, "about_link"]
HOME_FIELDS = [*PAGE_FIELDS, "company_name", "products", "contact_link"]
#: Partners of a home page: its contact page, and the about page if that one is visited or not.
PARTNERS = ("c_", "b_", "a_")


def _schema(fields: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{name} {'bigint' if name == 'page_id' else 'string'}" for name in fields)


SENT = ", ".join(["url string", _schema(HOME_FIELDS), *[_schema(PAGE_FIELDS, p) for p in PARTNERS]])


def page_facts(pages: DataFrame, config: DirectoryConfig) -> DataFrame:
    """Compact fields of each page, its ``domain``, and whether it is a ``home`` page that fits."""
    text = F.col("text")
    fits = (relevance_score(text, config.product_categories) >= 2) & ~is_shop(text, config.ecommerce_indicators)
    rows = contact_rows(
        read_parsed(pages), config, company_name=company_name(F.col("url")),
        products=F.array_join(products(text, config.product_categories), ", "),
        contact_link=subpage_link(config.contact_keywords), about_link=subpage_link(fv.ABOUT_KEYWORDS), fits=fits)
    root = site_root("url")
    at_root = (F.col("url") == root) | (F.col("url") == F.concat(root, F.lit("/")))
    return rows.select(
        "url", *HOME_FIELDS, F.coalesce(F.col("fits") & at_root, F.lit(False)).alias("home"), root.alias("root"),
        F.coalesce(extract_domain("url"), F.lit("")).alias("domain"))


def _value(x: Any) -> Any:
    return None if x is None or x != x else x


class SitePages(StatefulProcessor):
    """Holds the pages of a site and sends its home pages with the pages they lead to."""

    def __init__(self, contact_slugs: Sequence[str], about_slugs: Sequence[str]):
        self.contact_slugs, self.about_slugs = list(contact_slugs), list(about_slugs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "url string", _schema(PAGE_FIELDS))
        self.homes = handle.getMapState("homes", "url string", _schema(HOME_FIELDS) + ", root string, partners string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for row in part.sort_values("page_id", na_position="last").to_dict("records"):
                url = (row["url"],)
                if row["url"] is None or self.pages.containsKey(url):
                    continue
                fields = {name: _value(row[name]) for name in HOME_FIELDS}
                fields["page_id"] = None if fields["page_id"] is None else int(fields["page_id"])
                self.pages.updateValue(url, tuple(fields[name] for name in PAGE_FIELDS))
                if row["home"]:
                    self.homes.updateValue(url, (*fields.values(), row["root"], None))
        out = []
        for url, home in list(self.homes.iterator()):
            known = dict(zip([*HOME_FIELDS, "root", "partners"], home))
            contact = self._page(known["contact_link"], known["root"], self.contact_slugs)
            found = [contact, self._page(contact["about_link"], known["root"], self.about_slugs) if contact else None,
                     self._page(known["about_link"], known["root"], self.about_slugs)]
            partners = ",".join(str(p["page_id"]) if p else "-" for p in found)
            if partners != known["partners"]:
                self.homes.updateValue(url, (*tuple(home)[:-1], partners))
                none = dict.fromkeys(PAGE_FIELDS)
                out.append([url[0], *[known[n] for n in HOME_FIELDS], *[(p or none)[n] for p in found for n in PAGE_FIELDS]])
        if out:
            columns = ["url", *HOME_FIELDS, *[p + n for p in PARTNERS for n in PAGE_FIELDS]]
            yield pd.DataFrame(out, columns=columns, dtype=object)

    def _page(self, link: str | None, root: str, slugs: list[str]) -> dict | None:
        """The page at the link; without a link, that at the first keyword path which exists."""
        for url in [link] if link else [f"{root}/{slug}" for slug in slugs]:
            page = self.pages.getValue((url,))
            if page is not None:
                return dict(zip(PAGE_FIELDS, page))
        return None

    def close(self) -> None:
        pass


def filled(met: DataFrame) -> DataFrame:
    """Home pages filled from their partners by the rules of the staged fill."""
    step = met.withColumn("_contact", F.col("c_page_id").isNotNull() & lacks_reach())
    step = fill_from_page(step, "c_", F.col("_contact"))
    step = step.withColumns({f"s_{n}": F.when(F.col("_contact"), F.col(f"b_{n}")).otherwise(F.col(f"a_{n}")) for n in PAGE_FIELDS})
    step = step.withColumn("_about", F.col("s_page_id").isNotNull() & lacks_reach())
    return fill_from_page(step, "s_", F.col("_about")).select(
        "page_id", "url", "company_name", *PERSON_FIELDS, "email", "phone", "country", "state", "city", "products")


def stream_sites(
    pages: DataFrame,
    config: DirectoryConfig,
    sink: str,
    checkpoint: str,
    on_metrics: Callable[[Progress], None] | None = None,
    total: int | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Versions of filled home pages, one sink partition per batch; stopping the query keeps what was written.

    ``partitions`` is the number of partitions of the state, the session's shuffle partitions unless given.
    """
    keeper = SitePages(keyword_slugs(config.contact_keywords), keyword_slugs(fv.ABOUT_KEYWORDS))
    met = page_facts(dealt(pages), config).groupBy("domain").transformWithStateInPandas(keeper, SENT, "update", "none")

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(filled(batch), sink, batch_id, on_metrics, total)

    with session_settings(pages.sparkSession, state_settings(partitions)):
        return met.writeStream.outputMode("update").foreachBatch(handle).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_sites(spark: SparkSession, sink: str) -> DataFrame:
    """The last version of each home page."""
    return first_per_key(spark.read.parquet(sink), ["url"], [F.desc("batch_id")]).drop("batch_id")


def finalize_sites(spark: SparkSession, sink: str, drop_duplicates: bool = True) -> DataFrame:
    """Output rows of a finished or stopped stream of sites; duplicates removed on demand (ST4)."""
    rows = latest_sites(spark, sink)
    return to_output(deduplicate(rows, ["page_id"]) if drop_duplicates else rows)
