"""Quirks of the scalar rules, row by row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.config import DirectoryConfig
from siteroster.functions.email import all_emails, name_from_email, normalize_email
from siteroster.functions.names import (
    clean_company_name,
    extract_role,
    is_person_name,
    is_valid_role,
    normalize_role,
)
from siteroster.functions.phone import normalize_phone
from siteroster.functions.places import normalize_country
from siteroster.functions.urls import (
    domain_company_name,
    domain_fallback_name,
    extract_domain,
    hostname,
    is_result_url,
    is_site_url,
    is_visit_url,
    query_slug,
    quote_plus,
    site_root,
)


def evaluate(spark, rule, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(rule(F.col("x"))).collect()]


def check(spark, rule, cases):
    assert dict(zip(cases, evaluate(spark, rule, cases))) == cases


def test_normalize_email(spark):
    check(spark, normalize_email, {
        " Info@Firm.CO.za\n": "info@firm.co.za",
        "a@example.com": None,
        "a@mail.example.com": "a@mail.example.com",
        "logo@2x.png": None,
        "logo@3x.com": None,
        "x@site.JPG": None,
        "no-at.com": None,
        "a@b@c.com": None,
        "a@b.c": None,
        "a@localhost": None,
    })


def test_all_emails_is_the_plain_scan(spark):
    text = "a@b.com_c@d.org.x@e.org <x.y+z@h-i.co.za> @@ q@w p@q.rs,t@u.vwx"
    import re

    assert evaluate(spark, all_emails, [text]) == [re.findall(fv.EMAIL_PATTERN, text)]


def test_name_from_email(spark):
    check(spark, name_from_email, {
        "jane.doe@x.org": "Jane Doe",
        "jane.mcDoe@x.org": "Jane Mcdoe",
        "Jane.doe@x.org": None,
        "info.desk@x.org": None,
        "jane@x.org": None,
        "jane..doe@x.org": None,
        "jane.doe2@x.org": None,
    })


def test_normalize_phone(spark):
    prefixes = fv.SAMPLE_PHONE_PREFIXES
    check(spark, lambda c: normalize_phone(c, prefixes), {
        "+254 700 123 456": "+254700123456",
        "254 700 123 456": "+254 700123456",
        "27 (11) 555-0100": "+27 115550100",
        "0115550100": "0115550100",
        "1234567": None,
        "2012345": "+20 12345",
        "7777777": None,
        "123456": None,
        "123456789012345": None,
        "27115550100 x": None,
        "": None,
    })


def test_prefix_that_is_the_whole_number(spark):
    check(spark, lambda c: normalize_phone(c, ["+1234567"]), {"1234567": "+1234567"})


def test_normalize_country(spark):
    names = ["Guinea", "Guinea-Bissau", "South Africa"]
    check(spark, lambda c: normalize_country(c, names), {
        " guinea-bissau ": "Guinea-Bissau",
        "GUINEA": "Guinea",
        "Guinea-B": "Guinea",
        "south africa rep": "South Africa",
        "sou": None,
        "Peru": None,
    })


def test_extract_domain(spark):
    check(spark, extract_domain, {
        "https://www.Firm.co.za:8080/x": "firm.co.za",
        "https://WWW.firm.org": "www.firm.org",
        "firm.org/path": "firm.org/path",
        "http://me:pw@host.org/": "me",
        "http://host.org?q=1#f": "host.org",
        "mailto:a@b.org": "a@b.org",
        "http://[::1/x": "http://[::1/x",
        "": "",
    })


def test_url_parts(spark):
    check(spark, hostname, {
        "https://u@Host.ORG:80/x": "host.org", "host.org": "", "http://a.b/c@d": "a.b",
    })
    check(spark, site_root, {"https://a.org/x?y": "https://a.org", "ftp://a.org/": None})


def test_names_from_hosts(spark):
    check(spark, domain_company_name, {
        "https://www.med4you.co.za/": "Med 4 You",
        "https://med-supply.com": "Med Supply",
        "https://abc.com:8080": "Com 8080",
        "https://co.za": None,
        "https://com.co": "Com",
        "https://shop.acme.org": "Acme",
        "https://über-1.org": "Ber 1",
    })
    check(spark, domain_fallback_name, {
        "https://www.med4you.co.za/": "Med4you",
        "acme.org/": "Acme",
        "https://ab.de": "Ab",
        "": "",
    })


def test_url_filters(spark):
    check(spark, lambda c: is_visit_url(c), {
        "https://a.org": True, "ftp://a.org": False, "https://www.x.com/a": False,
        "https://x.com": True, "https://netflix.com/": True, "https://a.org/f.pdf": False,
        "https://a.org/f.PDF": True, "https://google.com/search?q=1": False,
        "https://m.facebook.com/a": True,
    })
    check(spark, lambda c: is_site_url(c), {
        "https://m.facebook.com/a": False, "https://X.com": False, "https://netflix.com": True,
        "https://a.org": True, "/contact": False, "http://": True,
    })
    check(spark, lambda c: is_result_url(c, ["spam."]), {
        "https://Maps.Google.com/x": False, "https://spam.org": False, "https://ok.org": True,
        "https://ok.org/?u=youtube.com": False,
    })


def test_slug_and_encoding(spark):
    check(spark, query_slug, {
        "  CSSD distributor (Africa)! ": "cssd-distributor-africa", "é": "", "a" * 90: "a" * 80,
    })
    check(spark, quote_plus, {"a b*~é&/": "a+b%2A~%C3%A9%26%2F"})


def test_clean_company_name(spark):
    check(spark, clean_company_name, {
        " Acme Ltd ": "Acme Ltd", "ab": None, "a" * 101: None, "{{ name }}": None,
        "{% x %}": None, "a@b": None, "one two three four five six seven eight nine ten eleven": None,
        "Company Logo": None, "www.acme.org.": None, "Acme.org": "Acme.org", "acme_co": None,
        "acme_co ltd": "acme_co ltd", "": None, "{{ a\n}}": "{{ a\n}}",
    })


def test_is_person_name(spark):
    check(spark, lambda c: is_person_name(c, ["Steam"]), {
        "Anna Berg": True, "Anna": False, "anna berg": False, "Anna  Berg": False,
        "Anna The Berg": False, "Anna Manager": False, "Berg Industries": False,
        "Steam Berg": False, "Medical Anna Berg": True, "Medical Central Anna": False,
        "Ann Ab Cd Ef Gh": False, "Anna\nBerg": False, "Al B": False,
    })


def test_roles(spark):
    rows = spark.createDataFrame(
        [("Anna Berg - CEO", "Anna Berg"), ("Anna Berg: vice  president", "Anna Berg"),
         ("Head  of Anna Berg", "Anna Berg"), ("Anna Berg", "Anna Berg")], "line string, name string")
    got = [r[0] for r in rows.select(extract_role("line", "name")).collect()]
    assert got == ["CEO", "vice  president", "Head  of", None]
    check(spark, normalize_role, {"m.d.": "Managing Director", "HEAD OF": "Head", "Chef": "Chef"})
    check(spark, is_valid_role, {"": False, "x" * 59: True, "x" * 60: False})


def test_config_hash_ignores_query_order():
    one = DirectoryConfig(search_queries=("a", "b"), excluded_sites=("x",))
    two = DirectoryConfig(search_queries=("b", "a"), excluded_sites=("x",))
    assert one.search_hash() == two.search_hash()
    assert len(one.search_hash()) == 16
    assert one.search_hash() != DirectoryConfig(search_queries=("a",)).search_hash()


@pytest.mark.parametrize("pattern", fv.SAMPLE_PHONE_PATTERNS)
def test_patterns_compile(spark, pattern):
    assert evaluate(spark, lambda c: c.rlike(f"(?U){pattern}"), ["no digits"]) == [False]
