"""Page tables and field rules E0–E10, S1, S5, P6, P7, J6."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.email import all_emails
from siteroster.functions.names import is_person_name
from siteroster.functions.text import first_where
from siteroster.operators import contact
from siteroster.operators.company import company_name
from siteroster.operators.filters import flag_blocked_pages, flag_ecommerce
from siteroster.operators.html import (
    page_containment,
    page_lines,
    page_links,
    page_nodes,
    page_text,
    parse_pages,
    with_text,
)
from siteroster.operators.jsonld import page_jsonld
from siteroster.operators.person import contact_person, team
from siteroster.operators.results import parse_result_pages
from siteroster.plans.contacts import extract_contacts, read_parsed
from siteroster.registry import rendered as r
from siteroster.registry.base import Entry, sql_list, sql_values, table
from siteroster.session import spread
from siteroster.sources.pages import read_pages

CFG = r.CONFIG


def _pages(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet")


# ---- E0, S1, J6 over the page table ----------------------------------------
def _s1(spark, sf):
    return _pages(spark, sf).select("page_id", "url", F.md5("html").alias("html_md5"))


S1_SQL = "select page_id, url, md5(html) as html_md5 from pages where html is not null"

TEXT_CTE = """
t as (select page_id, url,
        replace(replace(replace(replace(
          regexp_replace(regexp_replace(regexp_replace(html, '&(amp|quot|copy|middot)<', '&\\1;<', 'g'), '<!--.*?-->|<style>.*?</style>|<script>.*?</script>|<!DOCTYPE[^>]*>', '', 'gs'), '<[^>]*>', '', 'g'),
          '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&') as text
      from pages)
"""


def _e0_text(spark, sf):
    return page_text(parse_pages(_pages(spark, sf), emails=False))


E0_TEXT_SQL = f"with {TEXT_CTE} select page_id, url, text from t"


def _e0_lines(spark, sf):
    return page_lines(parse_pages(_pages(spark, sf), emails=False))


E0_LINES_SQL = f"""
with {TEXT_CTE},
     l as (select page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> '') as ls from t)
select page_id, cast(generate_subscripts(ls, 1) - 1 as int) as line_no, unnest(ls) as line from l
"""


def _e0_links(spark, sf):
    return page_links(parse_pages(_pages(spark, sf), emails=False))


E0_LINKS_SQL = """
with h as (select page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') as links from pages),
     u as (select page_id, cast(generate_subscripts(links, 1) - 1 as int) as pos, unnest(links) as a from h)
select page_id, pos, replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&') as href,
       nullif(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&'), '') as first_text
from u
"""


def _e0_nodes(spark, sf):
    return page_nodes(parse_pages(_pages(spark, sf), emails=False)).groupBy("page_id", "tag").agg(
        F.count("*").alias("n")
    )


E0_NODES_SQL = """
with h as (select page_id, regexp_replace(html, '<!--.*?-->|<script>.*?</script>', '<script>', 'gs') as h from pages),
     u as (select page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)[ >]', 1)) as tag from h),
     c as (select page_id, length(regexp_extract_all(html, '<!--')) as comments from pages)
select page_id, tag, count(*) - max(case when tag = 'script' then comments else 0 end) as n
from u join c using (page_id) group by page_id, tag
"""


def _e0_jsonld(spark, sf):
    return page_jsonld(parse_pages(r.contact_pages(spark, sf), emails=False))


E0_JSONLD_SQL = f"""
with c as (select *, {r.TOWN} as town, {r.LAND} as land from {r.CONTACT_FROM}),
     a as (select c_custkey, 0 as pos, '{{"@type":"Place","address":{{"addressLocality":"' || town || '"}}}}' as item
           from c where c_custkey % 7 = 2),
     n as (select c_custkey, case when c_custkey % 7 = 2 then 1 else 0 end as k, land from c where c_custkey % 5 = 2)
select c_custkey as page_id, pos, item from a
union all select c_custkey, k, '{{"a":1}}' from n
union all select c_custkey, k + 1, '{{"@type":"Place","address":{{"addressRegion":"' || land || '"}}}}' from n
"""

def _j6(spark, sf):
    pairs = page_containment(
        parse_pages(_pages(spark, sf), emails=False), lambda n: n["tag"] == "nav", lambda n: n["tag"] == "a"
    )
    return pairs.groupBy("page_id", "ancestor_tag", "descendant_tag", "descendant_text").agg(
        F.count("*").alias("n")
    )


J6_SQL = """
with u as (select page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a [^>]*>([^<]*)</a>', 1)) as x from pages)
select page_id, 'nav' as ancestor_tag, 'a' as descendant_tag, replace(x, '&amp;', '&') as descendant_text, count(*) as n
from u group by page_id, x
"""

# ---- E1 ----------------------------------------------------------------------
EMAIL_OK = f"""
  split_part(e, '@', 2) not in ({sql_list(fv.PLACEHOLDER_DOMAINS)})
  and not regexp_matches(e, '\\.(png|jpg|jpeg|gif|svg|webp|ico|bmp)$')
  and not contains(e, '@2x.') and not contains(e, '@3x.')
"""


def _first_email_sql(source: str, key: str, text: str) -> str:
    return f"""
with h as (select {key}, regexp_extract_all({text}, '{fv.EMAIL_PATTERN}') as es from {source}),
     f as (select {key}, list_filter(list_transform(es, lambda x: lower(x)), lambda e: {EMAIL_OK})[1] as email from h)
select {key}, email from f
"""


def _e1_pages(spark, sf):
    pages = _pages(spark, sf)
    return pages.select("page_id", contact.email(all_emails("html")).alias("email"))


def _e1_documents(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", contact.email(all_emails("text")).alias("email"))


def _e1_rendered(spark, sf):
    pages = parse_pages(r.contact_pages(spark, sf))
    return pages.select("page_id", contact.email().alias("email"))


# ---- E2 over documents ---------------------------------------------------------
def _e2_documents(spark, sf):
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.array("text").alias("pieces"))
    phone = contact.phone(CFG.phone_patterns, CFG.phone_prefixes)
    return with_text(docs).select("doc_id", phone.alias("phone"))


_HITS = " union all ".join(
    f"select doc_id, line_no, {i} as p, regexp_extract_all(line, '{pattern}') as hs from kl"
    for i, pattern in enumerate(CFG.phone_patterns)
)
_WHOLE = " union all ".join(
    f"select doc_id, 0 as line_no, {i + 100} as p, regexp_extract(text, '{pattern}') as h from texts"
    for i, pattern in enumerate(CFG.phone_patterns)
)


def _phone_ctes(texts: str) -> str:
    """``w``: the phone of each row of ``texts`` (``doc_id, text``) that has one."""
    return f"""texts as ({texts}),
     l as (select doc_id, string_split(text, chr(10)) as ls from texts),
     u as (select doc_id, generate_subscripts(ls, 1) as line_no, unnest(ls) as line from l),
     kl as (select * from u where list_has_any(list_transform([{sql_list(fv.PHONE_LINE_WORDS)}], lambda k: contains(lower(line), k)), [true])),
     a as ({_HITS}),
     b as (select doc_id, line_no, p, generate_subscripts(hs, 1) as pos, unnest(hs) as h from a
           union all select doc_id, line_no, p, 1, h from ({_WHOLE})),
     c as (select *, regexp_replace(h, '[\\s().-]', '', 'g') as c from b where h <> ''),
     d as (select *, regexp_replace(c, '[^0-9]', '', 'g') as g, row_number() over () as rid from c),
     pre as (select substring(v.p, 2) as digits, v.p as prefix from (values {sql_values(CFG.phone_prefixes)}) v(i, p)),
     x as (select d.rid, max_by(pre.prefix, length(pre.digits)) as prefix, max(length(pre.digits)) as n
           from d join pre on starts_with(d.c, pre.digits) group by d.rid),
     z as (select d.*, case when length(g) not between 7 and 14 or replace(g, left(g, 1), '') = '' then null
                            when x.prefix is not null then x.prefix || ' ' || substring(c, x.n + 1)
                            when length(g) >= 9 then c end as phone
           from d left join x using (rid)),
     w as (select doc_id, arg_min(phone, (p, line_no, pos)) as phone from z where phone is not null group by doc_id)"""


E2_SQL = f"""
with {_phone_ctes("select doc_id, text from documents")}
select documents.doc_id, w.phone from documents left join w using (doc_id)
"""


def _field(name):
    def query(spark, sf):
        parsed = read_parsed(r.contact_pages(spark, sf))
        rules = {
            "phone": lambda: contact.phone(CFG.phone_patterns, CFG.phone_prefixes),
            "country": lambda: contact.country(CFG.countries, CFG.country_keywords),
            "city": contact.city,
            "state": contact.state,
        }
        return parsed.select("page_id", rules[name]().alias(name))

    return query


def _field_sql(name: str, expression: str) -> str:
    return f"select c_custkey as page_id, {expression} as {name} from {r.CONTACT_FROM}"


CATEGORIES = ["the", "quell", "Ist ", "nter", "the", "sterile", "ENTAI"]


def _e6(spark, sf):
    parsed = with_text(parse_pages(_pages(spark, sf), emails=False))
    named = F.array_join(contact.products(F.col("text"), CATEGORIES), ", ")
    return parsed.select("page_id", named.alias("products"))


E6_SQL = f"""
with {TEXT_CTE}
select page_id, array_to_string(list_filter([{sql_list(dict.fromkeys(CATEGORIES))}], lambda c: contains(lower(text), lower(c))), ', ') as products
from t
"""


def _a5(spark, sf):
    named = F.array_join(contact.products(F.col("text"), CATEGORIES), ", ")
    return table(spark, sf, "documents").select("doc_id", named.alias("products"))


A5_SQL = f"""
select doc_id, array_to_string(list_filter([{sql_list(dict.fromkeys(CATEGORIES))}], lambda c: contains(lower(text), lower(c))), ', ') as products
from documents
"""


def _e7(spark, sf):
    parsed = parse_pages(r.contact_pages(spark, sf))
    return parsed.select("page_id", company_name(F.col("url")).alias("company"))


def _e7_pages(spark, sf):
    parsed = parse_pages(_pages(spark, sf))
    return parsed.select("page_id", company_name(F.col("url")).alias("company"))


E7_PAGES_SQL = """
with h as (select page_id, string_split(regexp_extract(url, '://(?:www\\.)?([^/?#]*)', 1), '.') as l from pages)
select page_id, 'Example' as company from h where list_contains(l, 'example')
"""


def _e8(spark, sf):
    parsed = read_parsed(r.people_pages(spark, sf))
    rows = parsed.select("page_id", contact_person(CFG.non_person_words).alias("p"))
    return rows.select("page_id", F.col("p.name").alias("person"), F.col("p.role").alias("role"))


E8_SQL = f"""
select c_custkey as page_id, {r.PERSON_NAME} as person, {r.PERSON_ROLE} as role from customer
"""


def _e9(spark, sf):
    parsed = read_parsed(r.people_pages(spark, sf))
    words = CFG.non_person_words
    found = first_where(team(words), lambda c: is_person_name(c["name"], words))
    rows = parsed.select("page_id", found.alias("p")).where("p is not null")
    return rows.select("page_id", F.col("p.name").alias("person"), F.col("p.role").alias("role"))


E9_SQL = f"""
select c_custkey as page_id, {r.PERSON} as person, {r.PERSON_ROLE} as role
from customer where c_custkey % 15 < 6
"""


def _e10(spark, sf):
    return extract_contacts(r.contact_pages(spark, sf), CFG)


E10_SQL = f"""
select c_custkey as page_id, {r.URL} as url, {r.COMPANY} as company_name,
       cast(null as string) as contact_person, cast(null as string) as position,
       {r.EMAIL} as email, {r.PHONE} as phone, {r.COUNTRY} as country, {r.STATE} as state, {r.CITY} as city
from {r.CONTACT_FROM}
"""


def _e10_pages(spark, sf):
    return extract_contacts(_pages(spark, sf), CFG).select(*E10_PAGES_COLUMNS)


#: Person, position, state and city of raw pages follow rules that SQL cannot restate; rendered pages hold them.
E10_PAGES_COLUMNS = ["page_id", "url", "company_name", "email", "phone", "country"]
_COUNTRY_IN_TEXT = f"list_filter([{sql_list(CFG.countries)}], lambda c: regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || c || '([^A-Za-z0-9_]|$)'))[1]"
E10_PAGES_SQL = f"""
with e as ({_first_email_sql('pages', 'page_id', 'html')}), {TEXT_CTE.strip()},
     {_phone_ctes("select page_id as doc_id, text from t")}
select page_id, pages.url, 'Example' as company_name, email, w.phone, {_COUNTRY_IN_TEXT} as country
from pages join e using (page_id) join t using (page_id) left join w on w.doc_id = page_id
"""

# ---- S5, P6, P7 -----------------------------------------------------------------
RESULT_HTML = " || ".join([
    "case when page_id % 3 = 0 then '<div data-hveid=\"1\">' else '<div class=\"x tF2Cxc\">' end",
    "'<a href=\"' || url || '\">link ' || cast(page_id as string) || '</a>'",
    "case when page_id % 2 = 0 then '<h3>Head ' || cast(page_id as string) || '</h3>' else '' end",
    "'</div><div class=\"g\" data-hveid=\"2\"><a href=\"https://b.org/' || cast(page_id as string) || '\"></a></div>'",
    "'<div class=\"g\"><p><a href=\"https://last.org/\">Same</a></p></div>'",
    "'<div class=\"yuRUbf\"><a href=\"https://x.google.com/\">Gone</a></div>'",
    "'<div class=\"g\"><a href=\"https://later.org/\">Same</a></div>'",
])


def _s5(spark, sf):
    pages = _pages(spark, sf).withColumn("html", F.expr(RESULT_HTML))
    return parse_result_pages(parse_pages(pages, emails=False), ["spam-farm"])


S5_SQL = """
with f as (select page_id, url, page_id % 3 = 0 as spare, not contains(lower(url), 'spam-farm') as ok from pages)
select page_id, case when page_id % 2 = 0 then 'Head ' else 'link ' end || page_id as title, 0 as pos, url
from f where not spare and ok
union all select page_id, 'Unknown', case when spare then 0 else 1 end, 'https://b.org/' || page_id from f
union all select page_id, 'Same', case when spare then 1 else 2 end, 'https://later.org/' from f
"""


def _p6(spark, sf):
    return flag_ecommerce(with_text(parse_pages(r.shop_pages(spark, sf), emails=False)), CFG.ecommerce_indicators)


P6_SQL = f"""
select p_partkey as page_id, {r.SHOP_SCORE} as text_score, cast({r.SHOP_COUNT} as int) as element_count,
       {r.SHOP_SCORE} >= 6 and {r.SHOP_COUNT} >= 3 as is_shop
from part
"""

BLOCK_HTML = (
    "case page_id % 11 when 3 then html || '<p>Unusual Traffic</p>' "
    "when 5 then html || '<iframe src=\"/ReCaptcha/1\"></iframe>' "
    "when 7 then html || '<div id=\"x-captcha\"></div>' else html end"
)


def _p7(spark, sf):
    pages = _pages(spark, sf).withColumn("html", F.expr(BLOCK_HTML))
    return flag_blocked_pages(pages).select("page_id", "is_blocked")


P7_SQL = f"""
with b as (select page_id, lower({BLOCK_HTML}) as h from pages)
select page_id, list_has_any(list_transform([{sql_list(fv.BLOCKED_PHRASES)}], lambda k: contains(h, k)), [true]) as is_blocked
from b
"""

ENTRIES: dict[str, Entry] = {
    "s1_read_pages": (_s1, S1_SQL),
    "s5_parse_result_pages": (_s5, S5_SQL),
    "p6_flag_ecommerce": (_p6, P6_SQL),
    "p7_flag_blocked_pages": (_p7, P7_SQL),
    "j6_page_containment": (_j6, J6_SQL),
    "e0_page_text": (_e0_text, E0_TEXT_SQL),
    "e0_page_lines": (_e0_lines, E0_LINES_SQL),
    "e0_page_links": (_e0_links, E0_LINKS_SQL),
    "e0_page_nodes": (_e0_nodes, E0_NODES_SQL),
    "e0_page_jsonld": (_e0_jsonld, E0_JSONLD_SQL),
    "e1_extract_emails_pages": (_e1_pages, _first_email_sql("pages", "page_id", "html")),
    "e1_extract_emails_documents": (_e1_documents, _first_email_sql("documents", "doc_id", "text")),
    "e1_extract_emails": (_e1_rendered, _field_sql("email", r.EMAIL)),
    "e2_extract_phones_documents": (_e2_documents, E2_SQL),
    "e2_extract_phones": (_field("phone"), _field_sql("phone", r.PHONE)),
    "e3_extract_country": (_field("country"), _field_sql("country", r.COUNTRY)),
    "e4_extract_city": (_field("city"), _field_sql("city", r.CITY)),
    "e5_extract_state": (_field("state"), _field_sql("state", r.STATE)),
    "e6_extract_products": (_e6, E6_SQL),
    "a5_product_list": (_a5, A5_SQL),
    "e7_extract_company_name": (_e7, _field_sql("company", r.COMPANY)),
    "e7_extract_company_name_pages": (_e7_pages, E7_PAGES_SQL),
    "e8_extract_contact_person": (_e8, E8_SQL),
    "e9_extract_team": (_e9, E9_SQL),
    "e10_extract_contacts": (_e10, E10_SQL),
    "e10_extract_contacts_pages": (_e10_pages, E10_PAGES_SQL),
}
