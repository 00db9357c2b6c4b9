"""Scalar rules X1–X12 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.email import name_from_email, normalize_email
from siteroster.functions.names import (
    clean_company_name,
    extract_role,
    is_person_name,
    is_valid_role,
)
from siteroster.functions.phone import normalize_phone
from siteroster.functions.places import normalize_country
from siteroster.functions.urls import (
    domain_company_name,
    domain_fallback_name,
    extract_domain,
    query_slug,
)
from siteroster.registry.base import Entry, choose, sql_list, sql_values, table

KEY = "cast(c_custkey as string)"

EMAIL_RAW = choose("c_custkey", [
    f"'  Sales' || {KEY} || '@Firm' || {KEY} || '.CO.ZA '",
    f"'user' || {KEY} || '@example.com'",
    f"'img' || {KEY} || '@2x.png'",
    f"'x.y' || {KEY} || '@mail' || {KEY} || '.example.com'",
    f"'no-at-sign-' || {KEY} || '.com'",
    f"'a+b_' || {KEY} || '@host.c'",
    f"'photo@site' || {KEY} || '.JPEG'",
    f"'k' || {KEY} || '@localhost'",
    f"'two@at@site' || {KEY} || '.org'",
])


def _x1(spark, sf):
    raw = table(spark, sf, "customer").select("c_custkey", F.expr(EMAIL_RAW).alias("raw"))
    return raw.withColumn("email", normalize_email("raw"))


X1_SQL = f"""
with r as (select c_custkey, {EMAIL_RAW} as raw from customer),
     t as (select *, lower(trim(raw)) as e, split_part(lower(trim(raw)), '@', 2) as d from r)
select c_custkey, raw,
       case when regexp_full_match(e, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}')
             and d not in ({sql_list(fv.PLACEHOLDER_DOMAINS)})
             and not regexp_matches('@' || d, '\\.(png|jpg|jpeg|gif|svg|webp|ico|bmp)$')
             and not contains('@' || d, '@2x.') and not contains('@' || d, '@3x.')
            then e end as email
from t
"""

DIGITS = "lpad(cast(c_custkey as string), 6, '4')"
PHONE_RAW = choose("c_custkey", [
    f"'+254 ' || {DIGITS} || '12'",
    f"'254-' || {DIGITS} || '.99'",
    f"'27 (11) ' || {DIGITS}",
    f"'(020) ' || {DIGITS}",
    f"'12' || {DIGITS} || '34'",
    f"'4' || {DIGITS}",
    f"'777-777-7777'",
    f"{DIGITS} || {DIGITS} || {DIGITS}",
    f"'20' || {DIGITS} || ' ext'",
    f"'12-' || cast(c_custkey as string)",
])


def _x2(spark, sf):
    raw = table(spark, sf, "customer").select("c_custkey", F.expr(PHONE_RAW).alias("raw"))
    return raw.withColumn("phone", normalize_phone("raw", fv.SAMPLE_PHONE_PREFIXES))


X2_SQL = f"""
with r as (select c_custkey, {PHONE_RAW} as raw from customer),
     t as (select *, regexp_replace(raw, '[\\s().-]', '', 'g') as c from r),
     d as (select *, regexp_replace(c, '[^0-9]', '', 'g') as g from t),
     p as (select substring(v.p, 2) as digits, v.p as prefix from (values {sql_values(fv.SAMPLE_PHONE_PREFIXES)}) v(i, p)),
     hit as (select d.c_custkey, max_by(p.prefix, length(p.digits)) as prefix, max(length(p.digits)) as n
             from d join p on starts_with(d.c, p.digits) group by d.c_custkey)
select d.c_custkey, d.raw,
       case when not regexp_matches(c, '[0-9]$') or length(g) not between 7 and 14
              or replace(g, left(g, 1), '') = '' then null
            when hit.prefix is not null then hit.prefix || ' ' || substring(c, hit.n + 1)
            when length(g) >= 9 then c end as phone
from d left join hit using (c_custkey)
"""

COUNTRIES = ["NATION_1", "Nation_10", "NATION_2", "Nation_21 Islands", "NATION_3"]
COUNTRY_RAW = choose("c_custkey", [
    "n_name", "'  ' || lower(n_name) || ' '", "n_name || ' Republic'", "left(n_name, 3)",
    "left(n_name, 5)",
])


def _x3(spark, sf):
    rows = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    raw = rows.select("c_custkey", F.expr(COUNTRY_RAW).alias("raw"))
    return raw.withColumn("country", normalize_country("raw", COUNTRIES))


X3_SQL = f"""
with r as (select c_custkey, {COUNTRY_RAW} as raw from customer join nation on c_nationkey = n_nationkey),
     t as (select *, lower(trim(raw)) as c from r),
     w as (select i, v, lower(v) as l from (values {sql_values(COUNTRIES)}) x(i, v)),
     e as (select t.c_custkey, min_by(v, i) as v from t join w on t.c = w.l group by 1),
     n as (select t.c_custkey, min_by(v, i) as v from t join w
           on length(t.c) > 3 and (starts_with(w.l, t.c) or starts_with(t.c, w.l)) group by 1)
select t.c_custkey, t.raw, coalesce(e.v, n.v) as country
from t left join e using (c_custkey) left join n using (c_custkey)
"""

URL_RAW = choose("page_id", [
    "url", "replace(url, '://', '://www.')", "replace(url, '://', '://WWW.')",
    "replace(replace(url, 'https://', ''), 'http://', '')",
    "replace(url, '.example.', '.example.co:8080.')", "replace(url, '://', '://me:pw@')",
    "replace(url, '/en/', '?q=/en/')",
])


def _x4(spark, sf):
    raw = table(spark, sf, "pages").select("page_id", F.expr(URL_RAW).alias("raw"))
    return raw.withColumn("domain", extract_domain("raw"))


X4_SQL = f"""
with r as (select page_id, {URL_RAW} as raw from pages),
     t as (select *, case when contains(raw, '://') then regexp_extract(raw, '://([^/?#]*)', 1)
                          else regexp_extract(raw, '^([^?#]*)', 1) end as place from r)
select page_id, raw, lower(split_part(regexp_replace(place, '^www\\.', ''), ':', 1)) as domain from t
"""

HOST_JOIN = choose("p_partkey", ["'-'", "''", "'4'", "'.'"])
HOST_TAIL = choose("p_partkey", ["'.com'", "'.co.za'", "'.org/about?x=1'", "'.com.au:8080'", "'.de'"])
HOST_RAW = f"'https://www.' || replace(p_name, ' ', {HOST_JOIN}) || {HOST_TAIL}"


def _x5(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(HOST_RAW).alias("raw"))
    return raw.withColumn("name", domain_company_name("raw"))


def _cap(x: str) -> str:
    return f"upper(left({x}, 1)) || substring({x}, 2)"


X5_SQL = f"""
with r as (select p_partkey, {HOST_RAW} as raw, p_partkey % 4 as j, p_partkey % 5 as t,
                  split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part)
select p_partkey, raw,
       case when t = 3 then 'Au 8080'
            when j = 0 then {_cap('a')} || ' ' || {_cap('b')}
            when j = 1 then {_cap('a')} || b
            when j = 2 then {_cap('a')} || ' 4 ' || {_cap('b')}
            when length(b) >= 3 then {_cap('b')}
            else {_cap('a')} end as name
from r
"""


def _x6(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(HOST_RAW).alias("raw"))
    return raw.withColumn("name", domain_fallback_name("raw"))


X6_SQL = f"""
with r as (select p_partkey, {HOST_RAW} as raw from part),
     h as (select *, regexp_replace(regexp_extract(raw, '://([^/?#]*)', 1), '^www\\.', '') as host from r),
     l as (select *, list_reverse(string_split(host, '.')) as labels from h),
     c as (select *, list_filter(labels, lambda x: x not in ({sql_list(fv.FALLBACK_SKIP_LABELS)}) and length(x) >= 3)[1] as hit,
                  labels[length(labels)] as head from l)
select p_partkey, raw, {_cap('coalesce(hit, head)')} as name from c
"""

COMPANY_RAW = choose("p_partkey", [
    "'  ' || p_name || ' '", "left(p_name, 2)", "p_name || '@site'", "'{{ ' || p_name || ' }}'",
    "replace(p_name, ' ', '_')", "'www.' || replace(p_name, ' ', '') || '.com.'",
    "p_name || ' ' || p_name || ' ' || p_name || ' ' || p_name || ' ' || p_name || ' x'",
    "'Company Logo'", "p_brand || ' ' || p_type", "'shopping cart'",
    "repeat(p_name || '-', 12)", "'{% block ' || p_name || ' %}'", "p_name || ' Ltd.'",
])


def _x7(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(COMPANY_RAW).alias("raw"))
    return raw.withColumn("company", clean_company_name("raw"))


X7_SQL = f"""
with r as (select p_partkey, {COMPANY_RAW} as raw from part),
     t as (select *, trim(raw) as n from r)
select p_partkey, raw,
       case when length(n) between 3 and 100
             and not regexp_matches(n, '\\{{\\{{.*?\\}}\\}}|\\{{%.*?%\\}}')
             and not contains(n, '@')
             and length(string_split_regex(n, '\\s+')) <= 10
             and lower(n) not in ({sql_list(fv.STOCK_IMAGE_ALTS)})
             and not regexp_full_match(trim(n, '.'), '((https?:)?//)?(www\\.)?[a-z0-9.-]+\\.[a-z]{{2,}}')
             and not (contains(n, '_') and not contains(n, ' '))
            then n end as company
from t
"""

PAIR = "regexp_extract(text, '^([^ \\n]+ [^ \\n]+)', 1)"
PERSON_RAW = choose("doc_id", [
    PAIR, "'Anna ' || lang", "'Anna Berg'", "'Anna Sales Manager'", "'Berg Ltd'",
    "'The Berg Anna'", "'Anna Medical Berg'", "'Anna Medical Berg Home'", "'Abc D'",
    "'Anna  Berg'", "'Steam Sterile'", "'Anna Maria Berg Lund'", "'Anna Maria Berg Lund Dahl'",
])
OTHER_WORDS = ["Steam", "Sterile", "Street"]


def _x8(spark, sf):
    pair = F.regexp_extract("text", r"^([^ \n]+ [^ \n]+)", 1)
    docs = table(spark, sf, "documents").withColumn("pair", pair)
    raw = docs.select("doc_id", F.expr(PERSON_RAW.replace(PAIR, "pair")).alias("raw"))
    return raw.withColumn("is_name", is_person_name("raw", OTHER_WORDS))


X8_SQL = f"""
with r as (select doc_id, {PERSON_RAW} as raw from documents),
     t as (select *, string_split(raw, ' ') as w from r)
select doc_id, raw,
       (length(raw) between 5 and 50
        and regexp_full_match(raw, '[A-Z][a-z]+( [A-Z][a-z]+){{1,3}}')
        and not regexp_matches(raw, '\\b(?i:{fv.ROLE_TITLES_PATTERN})\\b')
        and not list_has_any(w, [{sql_list(fv.NAME_SKIP_WORDS + fv.COMPANY_WORDS + OTHER_WORDS)}])
        and length(list_filter(w, lambda x: list_contains([{sql_list(fv.NOISE_WORDS)}], x))) / length(w) < 0.4) as is_name
from t
"""

ROLE_WORDS = ["CEO", "managing director", "Vice President", "head of sales", "Sales manager",
              "Technician", "VP", "nobody"]
ROLE_CANON = ["'CEO'", "'Managing Director'", "'Vice President'", "'Head'", "'Sales Manager'",
              "'Technician'", "'VP'", "null"]
ROLE_LINE = "'Anna Berg' || " + choose("c_custkey", ["' - '", "': '", "', '", "' — '", "' ;, '"]) + " || " + \
    choose("c_custkey", [f"'{r}'" for r in ROLE_WORDS]) + " || ' of ' || c_name"


def _x9(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(ROLE_LINE).alias("line"))
    return rows.withColumn("role", extract_role("line", F.lit("Anna Berg")))


X9_SQL = f"""
select c_custkey, {ROLE_LINE} as line, {choose('c_custkey', ROLE_CANON)} as role from customer
"""


def _x10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", is_valid_role("text").alias("ok"))


X10_SQL = "select doc_id, length(text) between 1 and 59 as ok from documents"


def _x11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", query_slug("text").alias("slug"))


X11_SQL = """
select doc_id, left(lower(trim(regexp_replace(text, '[^a-zA-Z0-9]+', '-', 'g'), '-')), 80) as slug
from documents
"""

MAILBOX_RAW = choose("c_custkey", [
    "'anna.berg@x.org'", "'info.berg@x.org'", "'Anna.berg@x.org'", "'anna@x.org'",
    "'anna.berg2@x.org'", "'anna.maria.bergLund@x.org'", "'anna..berg@x.org'",
]) + " || '/' || cast(c_custkey as string)"


def _x12(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(MAILBOX_RAW).alias("raw"))
    return rows.withColumn("name", name_from_email("raw"))


X12_SQL = f"""
select c_custkey, {MAILBOX_RAW} as raw,
       case c_custkey % 7 when 0 then 'Anna Berg' when 5 then 'Anna Maria Berglund' end as name
from customer
"""

ENTRIES: dict[str, Entry] = {
    "x1_normalize_email": (_x1, X1_SQL),
    "x2_normalize_phone": (_x2, X2_SQL),
    "x3_normalize_country": (_x3, X3_SQL),
    "x4_extract_domain": (_x4, X4_SQL),
    "x5_domain_company_name": (_x5, X5_SQL),
    "x6_domain_fallback_name": (_x6, X6_SQL),
    "x7_clean_company_name": (_x7, X7_SQL),
    "x8_is_person_name": (_x8, X8_SQL),
    "x9_extract_role": (_x9, X9_SQL),
    "x10_is_valid_role": (_x10, X10_SQL),
    "x11_query_slug": (_x11, X11_SQL),
    "x12_name_from_email": (_x12, X12_SQL),
}
