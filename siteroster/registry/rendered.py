"""Pages rendered from table columns, so the expected fields are plain columns.

Each fixture varies with the key modulo small coprime numbers: every stage of
a rule is met, and the number of pages grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.config import DirectoryConfig
from siteroster.registry.base import choose, table
from siteroster.session import spread

NATIONS = [f"NATION_{i}" for i in range(25)]
CONFIG = DirectoryConfig.sample(
    countries=tuple(NATIONS),
    contact_keywords=("contact", "reach us"),
    product_categories=("ring", "gizmo", "steam bolt"),
    non_person_words=("Steam", "Sterile", "Street"),
)
FIELDS = ["email", "phone", "country", "state", "city"]

K = "cast(c_custkey as string)"
NL = "'\\n'"
SUFFIX = "lpad(cast(c_custkey % 1000000 as string), 6, '4')"

# ---- contact pages: customer ⋈ nation --------------------------------------
URL = f"'https://www.firm' || {K} || '.co.za/'"
COMPANY_HTML = choose("c_custkey", [
    f"""'<meta property="og:site_name" content=" Firm ' || {K} || ' Group ">'""",
    f"""'<meta name="application-name" content="Works ' || {K} || '">'""",
    f"""'<header><a href="/"><img src="l.png" alt="Brand ' || {K} || ' Co"></a></header>'""",
    f"""'<meta property="og:site_name" content="logo"><a class="logo big"><img alt="Sign ' || {K} || '"></a>'""",
    f"""'<footer>&copy; 2024 Plant ' || cast(c_custkey % 100 as string) || ' Makers. All rights reserved</footer>'""",
    "'<header><img alt=\"home\"></header>'",
])
COMPANY = choose("c_custkey", [
    f"'Firm ' || {K} || ' Group'", f"'Works ' || {K}", f"'Brand ' || {K} || ' Co'",
    f"'Sign ' || {K}", "'Plant ' || cast(c_custkey % 100 as string) || ' Makers'", f"'Firm ' || {K}",
])
EMAIL_HTML = choose("c_custkey", [
    f"""'<a href="mailto:sales@firm' || {K} || '.co.za">write</a>'""",
    f"'<p>user@example.com or info@firm' || {K} || '.co.za</p>'",
    "'<img src=\"logo@2x.png\">'",
    f"'<p>INFO@FIRM' || {K} || '.ORG</p>'",
])
EMAIL = choose("c_custkey", [
    f"'sales@firm' || {K} || '.co.za'", f"'info@firm' || {K} || '.co.za'",
    "cast(null as string)", f"'info@firm' || {K} || '.org'",
])
PHONE_HTML = choose("c_custkey", [
    f"'<p>Tel: +27115' || {SUFFIX} || '</p>'",
    f"'<p>Phone</p>' || {NL} || '<p>hotel 27-115-' || {SUFFIX} || ' day</p>'",
    f"'<p>Desk 0115 555 ' || left({SUFFIX}, 4) || ' day</p>'",
    "'<p>Tel: 7777777</p>'",
    "'<p>Call me</p>'",
])
PHONE = choose("c_custkey", [
    f"'+27115' || {SUFFIX}", f"'+27 115' || {SUFFIX}", f"'0115555' || left({SUFFIX}, 4)",
    "cast(null as string)", "cast(null as string)",
])
COUNTRY_HTML = choose("c_custkey", [
    "'<p>Based at ' || lower(n_name) || ', floor 2</p>'",
    "'<div>Seat <div><p>Address: here </p>' || n_name || '</div>x</div>'",
    "'<p>No land</p>'",
])
COUNTRY = choose("c_custkey", ["n_name", "n_name", "cast(null as string)"])
TOWN = choose("c_custkey", ["'Lusaka'", "'Port Louis'", "'Accra'"])


def _json(key: str, value: str, style: str) -> str:
    body = f"""'{{"@type":"Place","address":{{"{key}":"' || {value} || '"}}}}'"""
    inner = body if style == "object" else f"'[{{\"a\":1}},' || {body} || ']'"
    return f"""'<script type="application/ld+json">' || {inner} || '</script>'"""


CITY_HTML = choose("c_custkey", [
    f"""'<meta itemprop="addressLocality" content="' || {TOWN} || '">'""",
    f"""'<span class="my-City">' || {TOWN} || '</span>'""",
    _json("addressLocality", TOWN, "object"),
    f"'<p>city life</p>' || {NL} || '<p>Town: ' || {TOWN} || '.</p>'",
    f"'<p>' || {TOWN} || ', Kenya</p>' || {NL} || '<p>x</p>' || {NL} || '<p>Email: see above</p>'",
    f"'<p>Village: lower</p>'",
    f"""'<b itemprop="addressLocality"> ' || {TOWN} || ' </b>'""",
])
CITY = choose("c_custkey", [TOWN, TOWN, TOWN, TOWN, TOWN, "cast(null as string)", TOWN])
LAND = choose("c_custkey", ["'Gauteng'", "'North Bank'"])
STATE_HTML = choose("c_custkey", [
    f"""'<i itemprop="addressRegion">' || {LAND} || '</i>'""",
    f"""'<i class="county">' || {LAND} || '</i>'""",
    _json("addressRegion", LAND, "array"),
    f"'<p>District - ' || {LAND} || '.</p>'",
    "'<p>stateless</p>'",
])
STATE = choose("c_custkey", [LAND, LAND, LAND, LAND, "cast(null as string)"])
CONTACT_HTML = " || ".join([
    "'<!DOCTYPE html><html><head><title>Page</title>'", COMPANY_HTML, "'</head><body>'", NL,
    EMAIL_HTML, NL, PHONE_HTML, NL, COUNTRY_HTML, NL, CITY_HTML, NL, STATE_HTML, NL,
    "'</body></html>'",
])
CONTACT_FROM = "customer join nation on c_nationkey = n_nationkey"


def contact_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.select(
        F.col("c_custkey").alias("page_id"), F.expr(URL).alias("url"),
        F.expr(CONTACT_HTML).alias("html"),
    )


# ---- people pages: customer ------------------------------------------------
PERSON = choose("c_custkey", ["'Anna Berg'", "'Joan Maria Lund'", "'Peter Dahl'", "'Eva Strand'"])
LOCAL = choose("c_custkey", ["'anna.berg'", "'joan.maria.lund'", "'peter.dahl'", "'eva.strand'"])
TEAM_HTML = [
    f"""'<div class="team-member"><h3>' || {PERSON} || '</h3><p class="job-title">Chief of all</p></div>'""",
    f"""'<li class="Staff"><strong>' || {PERSON} || '</strong> <span>our Sales Manager</span></li>'""",
    f"""'<div class="profile"><b>Steam Sterile</b><p>CEO</p></div><div class="board"><h4>' || {PERSON} || '</h4>|<i>VP</i><p>, text</p></div>'""",
    f"""'<table><tr><td>Name</td><td>Role</td></tr><tr><td>' || {PERSON} || '</td><td>Technician here</td></tr></table>'""",
    f"""'<section><h2>Our Team</h2><p>Intro</p><p>' || {PERSON} || '</p><p>since 1990</p><p>Founder</p></section>'""",
    f"""'<section><h2>Our Team</h2><p>Olga Holm</p><p>' || {PERSON} || '</p><p>Owner</p></section>'""",
]
TEAM_ROLE = ["'Chief'", "'Sales Manager'", "'VP'", "'Technician'", "'Founder'", "'Owner'"]
PEOPLE_HTML = choose("c_custkey", TEAM_HTML + [
    f"""'<meta name="author" content=" ' || {PERSON} || ' ">'""",
    f"""'<script type="application/ld+json">[{{"@type":"Thing"}},{{"@type":"Person","name":"' || {PERSON} || '","jobTitle":"Buyer"}}]</script>'""",
    f"""'<script type="application/ld+json">{{"@type":"Organization","name":"X","founder":{{"@type":"Person","name":"' || {PERSON} || '"}}}}</script>'""",
    f"""'<a href="mailto:' || {LOCAL} || '@firm.org">x</a>'""",
    f"""'<p>sales@firm.org, ' || {PERSON} || ', Owner</p>'""",
    f"""'<p>Sales manager: ' || {PERSON} || '</p>'""",
    f"""'<p>' || {PERSON} || ' - Head of sales</p>'""",
    f"""'<p>Coordinator is Cookie Policy and ' || {PERSON} || '</p>'""",
    "'<p>Cookie Policy: Home Page</p>'",
])
PERSON_NAME = choose("c_custkey", [PERSON] * 14 + ["cast(null as string)"])
PERSON_ROLE = choose("c_custkey", TEAM_ROLE + [
    "cast(null as string)", "'Buyer'", "cast(null as string)", "cast(null as string)", "'Owner'",
    "'Sales Manager'", "'Head of sales'", "'Coordinator'", "cast(null as string)",
])


def people_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer")).select(
        F.col("c_custkey").alias("page_id"), F.expr(URL).alias("url"),
        F.expr(f"'<html><body>' || {PEOPLE_HTML} || '</body></html>'").alias("html"),
    )


# ---- shop pages: part --------------------------------------------------------
SHOP_HTML = " || ".join([
    "'<div>add to basket, payment, shipping, delivery, price</div>'",
    "case when p_partkey % 3 = 0 then '<p>Buy now, order</p>' else '<p>store</p>' end",
    "repeat('<a><b>Add to Cart</b></a>', cast(p_size % 5 as int))",
    "repeat('<ul class=\"x catalog\"><li>a</li><li>b</li></ul>', cast(p_partkey % 3 as int))",
    "'<div>Cart <b>bold</b></div>'",
])
# indicators that occur in the text, per variant
SHOP_SCORE = (
    "(5 + case when p_partkey % 3 = 0 then 2 else 1 end + case when p_size % 5 > 0 then 1 else 0 end)"
)
SHOP_COUNT = "(1 + p_size % 5 + p_partkey % 3)"


def shop_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("page_id"), F.lit("https://s.org/").alias("url"),
        F.expr(SHOP_HTML).alias("html"),
    )


# ---- sites with contact and about pages: supplier ----------------------------
S = "cast(s_suppkey as string)"
ROOT = f"('https://site' || {S} || '.org')"
TAG = f"lpad({S}, 6, '3')"


def bit(n: int) -> str:
    return f"((s_suppkey % 32 - s_suppkey % {1 << n}) / {1 << n}) % 2 >= 1"


HOME_MAIL, HOME_PHONE, CONTACT_MAIL, CONTACT_PHONE, ABOUT_PHONE = (bit(n) for n in range(5))
# contact page: by link text, by address, relative link (refused), only by probing
CONTACT_LINK = choose("s_suppkey", [
    f"""'<a href="' || {ROOT} || '/c1">Contact</a>'""",
    f"""'<a href="/contact">Contact</a><a href="' || {ROOT} || '/reach-us">here</a>'""",
    "'<a href=\"/contact\">Contact</a>'",
])
CONTACT_URL = choose("s_suppkey", [
    f"{ROOT} || '/c1'", f"{ROOT} || '/reach-us'", f"{ROOT} || '/contact'",
])
ABOUT_URL = f"{ROOT} || '/about-x'"


def _mail(name: str) -> str:
    return f"'<p>{name}@site' || {S} || '.org</p>'"


def _tel(lead: str) -> str:
    return f"'<p>Tel: {lead}' || {TAG} || '</p>'"


def _name(key: str) -> str:
    return f"md5('site' || cast({key} as string))"


# every sixteenth name resembles the one before it; some sites do not fit, some are shops
SITE_NAME = f"case when s_suppkey % 16 = 15 then {_name('s_suppkey - 1')} || 'zz' else {_name('s_suppkey')} end"
FITS = "s_suppkey % 13 <> 5"
SHOP = "s_suppkey % 17 = 3"
HOME_HTML = " || ".join([
    "'<html><head><meta property=\"og:site_name\" content=\"'", SITE_NAME, "'\"></head><body>'",
    f"case when {FITS} then '<p>ring manufacturer</p>' else '<p>manufacturer</p>' end", NL,
    f"case when {SHOP} then '<div>add to basket, payment, shipping, delivery, price, store</div><a>Cart</a><a>Cart</a>' else '' end", NL,
    f"case when {HOME_MAIL} then {_mail('home')} else '' end", NL,
    f"case when {HOME_PHONE} then {_tel('2711')} else '' end", NL, CONTACT_LINK,
])
SUB_HTML = " || ".join([
    f"case when {CONTACT_MAIL} then {_mail('contact')} else '' end", NL,
    f"case when {CONTACT_PHONE} then {_tel('2722')} else '' end", NL,
    "'<p>City: Accra.</p>'", NL, f"""'<a href="' || {ABOUT_URL} || '">About</a>'""",
])
ABOUT_HTML = " || ".join([
    f"case when {ABOUT_PHONE} then {_tel('2733')} else '' end", NL,
    "'<p>State: Gauteng.</p>'", NL, "'<p>' || n_name || '</p>'",
])


def site_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "supplier")).join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    kinds = [(f"{ROOT} || '/'", HOME_HTML), (CONTACT_URL, SUB_HTML), (ABOUT_URL, ABOUT_HTML)]
    pages = F.array(*[
        F.struct(F.lit(i).alias("kind"), F.expr(u).alias("url"), F.expr(h).alias("html"))
        for i, (u, h) in enumerate(kinds)
    ])
    flat = rows.select("s_suppkey", F.explode(pages).alias("p"))
    return flat.select(
        (F.col("s_suppkey") * 3 + F.col("p.kind")).alias("page_id"), "p.url", "p.html"
    )


def site_results(spark: SparkSession, sf: str) -> DataFrame:
    """One search result per supplier site; every tenth with a stock title."""
    return table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / 50).alias("query_pos"),
        F.concat(F.lit("query "), F.floor(F.col("s_suppkey") / 50)).alias("query"),
        F.col("s_suppkey").alias("rank"),
        F.expr("case when s_suppkey % 10 = 9 then ' Home Page ' else 'Title ' || cast(s_suppkey as string) end").alias("title"),
        F.expr(f"{ROOT} || '/'").alias("url"),
    )


# Expected fields of a site after the staged fill (SQL both engines read).
H_EMAIL = f"case when {HOME_MAIL} then 'home@site' || {S} || '.org' end"
H_PHONE = f"case when {HOME_PHONE} then '+27 11' || {TAG} end"
VISIT_CONTACT = f"(not ({HOME_MAIL}) or not ({HOME_PHONE}))"
C_EMAIL = f"case when {HOME_MAIL} then 'home@site' || {S} || '.org' when {CONTACT_MAIL} then 'contact@site' || {S} || '.org' end"
C_PHONE = f"case when {HOME_PHONE} then '+27 11' || {TAG} when {CONTACT_PHONE} then '+27 22' || {TAG} end"
VISIT_ABOUT = f"({VISIT_CONTACT} and (({C_EMAIL}) is null or ({C_PHONE}) is null))"
A_PHONE = f"case when ({C_PHONE}) is not null then {C_PHONE} when {VISIT_ABOUT} and {ABOUT_PHONE} then '+27 33' || {TAG} end"
F_CITY = f"case when {VISIT_CONTACT} then 'Accra' end"
F_STATE = f"case when {VISIT_ABOUT} then 'Gauteng' end"
F_COUNTRY = f"case when {VISIT_ABOUT} then n_name end"
SITE_FROM = "supplier join nation on s_nationkey = n_nationkey"

# ---- search results from the page table --------------------------------------
H1 = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"
QUERY = "'query ' || cast(page_id % 7 as string)"
SEARCH_TITLE = choose("page_id", [H1, H1, "'  About Us '", H1, f"left({H1}, 4)"])


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        (F.col("page_id") % 7).alias("query_pos"), F.expr(QUERY).alias("query"),
        F.col("page_id").alias("rank"), F.expr(SEARCH_TITLE).alias("title"), "url",
    )


SEARCH_CTE = f"""r as (select page_id % 7 as query_pos, {QUERY} as query, page_id as rank,
                  {SEARCH_TITLE} as title, url from pages)"""

