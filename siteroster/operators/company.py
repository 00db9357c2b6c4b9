"""Company name of a parsed page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.names import clean_company_name
from siteroster.functions.text import first, strip
from siteroster.functions.urls import domain_company_name
from siteroster.operators.html import (
    descendants,
    first_node,
    has_class,
    node_text,
    where_nodes,
)


def _meta(test) -> Column:
    return first_node(lambda n: (n["tag"] == "meta") & test(n))


def _below(outer: Column, test) -> Column:
    """Nodes passing the test below any of the outer nodes, in document order, each once."""
    inner = F.flatten(F.transform(outer, lambda o: F.filter(descendants(o), test)))
    return F.array_sort(F.array_distinct(inner))


def _logo_nodes() -> list[Column]:
    """First hit of each logo selector, most specific selector first."""

    def image(n: Column) -> Column:
        return (n["tag"] == "img") & n["alt"].isNotNull()

    def link(test):
        return lambda n: (n["tag"] == "a") & F.coalesce(test(n), F.lit(False))

    headers = where_nodes(lambda n: n["tag"] == "header")
    home_links = _below(headers, link(lambda n: n["href"] == "/"))
    return [
        first(_below(home_links, image)),
        first(_below(where_nodes(link(lambda n: has_class(n, "navbar-brand"))), image)),
        first(_below(where_nodes(link(lambda n: has_class(n, "logo"))), image)),
        first_node(lambda n: (n["tag"] == "img") & n["cls"].contains("logo")),
        first(_below(headers, image)),
    ]


def _copyright_owner() -> Column:
    footer = first_node(lambda n: n["tag"] == "footer")
    text = F.when(footer.isNotNull(), node_text(footer))
    owner = strip(F.regexp_extract(text, "(?U)" + fv.COPYRIGHT_PATTERN, 1))
    return F.rtrim(owner, F.lit(".,"))


def _named_on_page() -> Column:
    og_property = _meta(lambda n: n["property"] == "og:site_name")
    og_name = _meta(lambda n: n["name"] == "og:site_name")
    tags = [
        F.when(og_property.isNotNull(), og_property["content"]).otherwise(og_name["content"]),
        _meta(lambda n: n["name"] == "application-name")["content"],
        *[node["alt"] for node in _logo_nodes()],
        _copyright_owner(),
    ]
    return F.coalesce(*[clean_company_name(t) for t in tags])


def page_company_name(url: Column) -> Column:
    """Site name tags, logo texts, copyright line, then the host name if it passes as a name."""
    return F.coalesce(_named_on_page(), clean_company_name(domain_company_name(url)))


def company_name(url: Column, title: Column | None = None) -> Column:
    """``page_company_name``, else the result title, else the host name as it is; null if none."""
    late = [] if title is None else [clean_company_name(title)]
    return F.coalesce(page_company_name(url), *late, domain_company_name(url))
