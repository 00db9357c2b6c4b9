"""All contact fields of pages in one narrow pass."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.config import DirectoryConfig
from siteroster.operators import contact
from siteroster.operators.company import company_name
from siteroster.operators.html import parse_pages, with_text
from siteroster.operators.jsonld import jsonld_items
from siteroster.operators.person import contact_person


def read_parsed(pages: DataFrame) -> DataFrame:
    """Parsed pages with ``text``, ``lines`` and ``jsonld``: the input of all field rules."""
    return with_text(parse_pages(pages)).withColumn("jsonld", jsonld_items())


def contact_columns(config: DirectoryConfig) -> dict[str, Column]:
    """Field rules over a parsed row; ``person`` is a (name, role) struct."""
    return _contact_columns(config, SparkSession.active().sparkContext.applicationId)


@lru_cache(maxsize=8)
def _contact_columns(config: DirectoryConfig, application: str) -> dict[str, Column]:
    # Expressions do not depend on data: built once per application, used per batch and visit.
    return {
        "email": contact.email(),
        "phone": contact.phone(config.phone_patterns, config.phone_prefixes),
        "country": contact.country(config.countries, config.country_keywords),
        "state": contact.state(),
        "city": contact.city(),
        "person": contact_person(config.non_person_words),
    }


def contact_rows(parsed: DataFrame, config: DirectoryConfig, **more: Column) -> DataFrame:
    """``page_id, url`` and the contact fields, plus any further columns given."""
    columns = {**contact_columns(config), **more}
    rows = parsed.select("page_id", "url", *[c.alias(n) for n, c in columns.items()])
    return rows.withColumns(
        {"contact_person": F.col("person.name"), "position": F.col("person.role")}
    ).drop("person")


def extract_contacts(pages: DataFrame, config: DirectoryConfig) -> DataFrame:
    """One contact row per page.  HTML is parsed once; nothing is shuffled."""
    parsed = read_parsed(pages)
    return contact_rows(parsed, config, company_name=company_name(F.col("url"))).select(
        "page_id", "url", "company_name", "contact_person", "position",
        "email", "phone", "country", "state", "city",
    )
