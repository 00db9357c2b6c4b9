"""Gap filling, similar names, the whole directory, and streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.urls import extract_domain
from siteroster.operators.fill import (
    check_phone_country,
    fill_from_model,
    fill_from_pages,
    find_subpage,
    probe_subpage,
    subpage_link,
)
from siteroster.operators.html import parse_pages
from siteroster.operators.similar import dedup_similar_names, deduplicate, similar_name_pairs
from siteroster.plans.contacts import contact_rows, read_parsed
from siteroster.plans.directory import build_directory
from siteroster.registry import rendered as r
from siteroster.registry.base import Entry, choose, table
from siteroster.registry.tables import GAP, GAP_SELECT, _gap_rows, _scratch
from siteroster.session import materialize
from siteroster.streaming.contacts import (
    finalize,
    live_snapshot,
    read_page_stream,
    stream_contacts,
)
from siteroster.streaming.sites import finalize_sites, latest_sites, stream_sites

CFG = r.CONFIG


def _homes(spark, sf):
    return r.site_pages(spark, sf).where("page_id % 3 = 0")


def _j1(spark, sf):
    found = find_subpage(parse_pages(_homes(spark, sf), emails=False), CFG.contact_keywords)
    return found.select("url", "subpage_url")


J1_SQL = f"""
select {r.ROOT} || '/' as url, case when s_suppkey % 3 < 2 then {r.CONTACT_URL} end as subpage_url from supplier
"""


def _j2(spark, sf):
    sites = _homes(spark, sf).select("page_id", "url")
    return probe_subpage(sites, CFG.contact_keywords, r.site_pages(spark, sf)).select("url", "probe_url")


J2_SQL = f"""
select {r.ROOT} || '/' as url, case when s_suppkey % 3 > 0 then {r.CONTACT_URL} end as probe_url from supplier
"""


def _j3(spark, sf):
    pages = r.site_pages(spark, sf)
    extracted = materialize(
        contact_rows(read_parsed(pages), CFG, about_link=subpage_link(fv.ABOUT_KEYWORDS)), "pages"
    )
    homes = extracted.where("page_id % 3 = 0").drop("about_link")
    urls = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 3).alias("page_id"), F.expr(r.CONTACT_URL).alias("contact_url"),
        F.lit(None).cast("string").alias("about_url"),
    )
    filled = fill_from_pages(homes.join(urls, "page_id"), extracted)
    return filled.select("url", *r.FIELDS)


J3_SQL = f"""
select {r.ROOT} || '/' as url, {r.C_EMAIL} as email, {r.A_PHONE} as phone, {r.F_COUNTRY} as country,
       {r.F_STATE} as state, {r.F_CITY} as city
from {r.SITE_FROM}
"""

MODEL = {
    "country": "case when c_custkey % 4 = 0 then ' Ghana ' end",
    "state": "case when c_custkey % 4 < 2 then '  ' else 'North' end",
    "city": "case when c_custkey % 3 > 0 then 'Tema' end",
    "phone": "case when c_custkey % 6 = 5 then '0112223334' end",
    "email": "'model@x.org'",
}


def _j4(spark, sf):
    rows = _gap_rows(spark, sf).withColumnRenamed("c_custkey", "page_id").withColumn(
        "company_name", F.lit(None).cast("string")
    )
    model = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("page_id"),
        *[F.expr(v).alias(k) for k, v in MODEL.items()],
        F.expr("case when c_custkey % 2 = 0 then c_name end").alias("company_name"),
    )
    return fill_from_model(rows, model)


_ANY_GAP = "(g.email is null or g.phone is null or g.country is null or g.state is null or g.city is null)"
J4_SQL = f"""
with g as (select c_custkey as page_id, {GAP_SELECT} from customer),
     m as (select c_custkey as page_id, c_name, {', '.join(f"nullif(trim({v}), '') as {k}" for k, v in MODEL.items())}
           from customer where c_acctbal > 0)
select page_id, {', '.join(f"coalesce(g.{k}, m.{k}) as {k}" for k in GAP)},
       case when {_ANY_GAP} and page_id % 2 = 0 then m.c_name end as company_name
from g left join m using (page_id)
"""

PREFIX = "case when n_nationkey < 20 then '+' || cast(20 + n_nationkey as string) else '+20' || cast(n_nationkey - 20 as string) end"
J5_PHONE = "'+' || cast(20 + c_custkey % 23 as string) || ' ' || lpad(cast(c_custkey as string), 7, '3')"
# also numbers under a six-digit prefix, under a prefix with two owners, and without a leading plus
J5_PHONE = choose("c_custkey", [J5_PHONE, J5_PHONE, "cast(null as string)", J5_PHONE, "'+441481' || cast(c_custkey as string)",
                                "'+77 ' || cast(c_custkey as string)", "'2133' || cast(c_custkey as string)"])
J5_PREFIXES = """select {plus} as prefix, n_name as country from nation
union all select '+441481', 'Guernsey' union all select '+77', 'Ghana' union all select '+77', 'Togo'
union all select '+4414', 'Elsewhere'"""
J5_COUNTRY = choose("c_custkey", ["'Ghana'", "cast(null as string)", "'Ghana'"])


def _j5(spark, sf):
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("page_id"), F.expr(J5_PHONE).alias("phone"),
        F.expr(J5_COUNTRY).alias("country"),
    )
    prefixes = table(spark, sf, "nation").select(
        F.expr(PREFIX).alias("prefix"), F.col("n_name").alias("country")
    )
    more = [("+441481", "Guernsey"), ("+77", "Ghana"), ("+77", "Togo"), ("+4414", "Elsewhere")]
    return check_phone_country(rows, prefixes.union(spark.createDataFrame(more, prefixes.schema)))


J5_SQL = f"""
with c as (select c_custkey as page_id, {J5_PHONE} as phone, {J5_COUNTRY} as country from customer),
     p as (select replace(prefix, '+', '') as digits, list(distinct country) as owners
           from ({J5_PREFIXES.format(plus=PREFIX)}) group by 1),
     h as (select page_id, max_by(owners, length(digits)) as owners
           from c join p on starts_with(regexp_replace(phone, '[^0-9]', '', 'g'), digits)
           where starts_with(phone, '+') group by page_id)
select page_id, phone, case when len(owners) = 1 and country is not null then owners[1] else country end as country
from c left join h using (page_id)
"""

# ---- similar names: each supplier's digest and two near copies of it -------------
NAMES = {
    0: "md5(cast(s_suppkey as string))",
    1: "'  ' || upper(md5(cast(s_suppkey as string))) || 'ZZ '",
    2: "'q' || substring(md5(cast(s_suppkey as string)), 1, 30)",
}


def _names(spark, sf):
    copies = F.array(*[
        F.struct(F.lit(i).alias("copy"), F.expr(n).alias("name")) for i, n in NAMES.items()
    ])
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(copies).alias("c"))
    return rows.select(
        (F.col("c.copy") * 10000000 + F.col("s_suppkey")).alias("ord"), "c.name",
        F.concat(F.lit("https://h"), F.col("s_suppkey") % 70, F.lit("-"), "c.copy", F.lit(".org/")).alias("url"),
    )


def _j7(spark, sf):
    return similar_name_pairs(_names(spark, sf), ["ord"])


J7_SQL = """
with k as (select md5(cast(s_suppkey as string)) as a from supplier)
select a as earlier, a || 'zz' as later from k
union all select a, 'q' || left(a, 30) from k
union all select a || 'zz', 'q' || left(a, 30) from k
"""


def _d4(spark, sf):
    return dedup_similar_names(_names(spark, sf), ["ord"], "name").select("ord", "name")


D4_SQL = "select s_suppkey as ord, md5(cast(s_suppkey as string)) as name from supplier"


COPY_NAME = "'Common Supplies Group International ' || lpad(cast(c_custkey % 1000000 as string), 6, '0')"


def _d4_copies(spark, sf):
    """One group of near copies: any two names share 36 of 42 characters or more."""
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(COPY_NAME).alias("name"))
    return dedup_similar_names(rows, ["c_custkey"], "name")


D4_COPIES_SQL = f"select c_custkey, {COPY_NAME} as name from customer where c_custkey = (select min(c_custkey) from customer)"


def _d5(spark, sf):
    return deduplicate(_names(spark, sf), ["ord"], "name").select("ord", "name")


# per host (supplier key modulo 70, and copy) the first row stays, then similar names go
D5_SQL = """
with f as (select s_suppkey, md5(cast(s_suppkey as string)) as a from supplier
           qualify row_number() over (partition by s_suppkey % 70 order by s_suppkey) = 1)
select s_suppkey as ord, a as name from f
"""

# ---- the whole directory -----------------------------------------------------------
M_STATE = "case when s_suppkey % 3 = 0 then ' Home State ' end"
M_PHONE = "case when s_suppkey % 5 = 0 then '0112223334' end"


def _model(spark, sf):
    none = F.lit(None).cast("string")
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.expr(M_STATE).alias("state"), none.alias("phone")),
        F.struct(F.lit(1).alias("kind"), none.alias("state"), F.expr(M_PHONE).alias("phone")),
    )
    rows = table(spark, sf, "supplier").select("s_suppkey", F.explode(both).alias("m"))
    return rows.select(
        (F.col("s_suppkey") * 3 + F.col("m.kind")).alias("page_id"), "m.state", "m.phone",
        *[none.alias(n) for n in ("country", "city", "email", "company_name", "products")],
    )


E11_PREFIX = "case when n_nationkey = 0 then '+2733' else '+9' || cast(n_nationkey as string) end"


def _e11(spark, sf):
    prefixes = table(spark, sf, "nation").select(
        F.expr(E11_PREFIX).alias("prefix"), F.concat(F.lit("Land "), "n_name").alias("country")
    )
    rows = build_directory(
        r.site_results(spark, sf), r.site_pages(spark, sf), CFG, _model(spark, sf), prefixes
    )
    return rows.toDF(*[c.lower().replace(" ", "_") for c in rows.columns])


E11_SQL = f"""
with s as (select *, {r.ROOT} as root, {r.C_EMAIL} as final_email, {r.VISIT_CONTACT} as visit_contact,
                  coalesce({r.C_PHONE}, case when {r.VISIT_CONTACT} then {M_PHONE} end) as contact_phone,
                  case when {r.ABOUT_PHONE} then '+27 33' || {r.TAG} end as about_phone
           from {r.SITE_FROM}
           where s_suppkey % 10 <> 9 and {r.FITS} and not ({r.SHOP})),
     v as (select *, visit_contact and (final_email is null or contact_phone is null) as visit_about from s),
     f as (select *, coalesce(contact_phone, case when visit_about then about_phone end) as final_phone from v),
     k as (select * from f where s_suppkey % 16 <> 15 or s_suppkey - 1 not in (select s_suppkey from f))
select {r.SITE_NAME} as company_name, 'Not Found' as contact_person, 'Not Found' as position,
       case when visit_about then 'Gauteng' else coalesce(trim({M_STATE}), 'Not Found') end as state,
       case when visit_contact then 'Accra' else 'Not Found' end as city,
       case when not visit_about then 'Not Found'
            when starts_with(final_phone, '+27 33') and final_email is null then 'Land NATION_0'
            else n_name end as country,
       coalesce(final_phone, 'Not Found') as phone_number, coalesce(final_email, 'Not Found') as email,
       root || '/' as website, 'ring' as products
from k
"""


# ---- streams ------------------------------------------------------------------------
STREAM_BATCHES = 3


def _streamed(spark, sf, **options) -> str:
    """The page table as files, a third of them a batch."""
    path, sink, state = _scratch(spark, "page-files"), _scratch(spark, "sink"), _scratch(spark, "state")
    per_batch = spark.sparkContext.defaultParallelism
    table(spark, sf, "pages").repartition(STREAM_BATCHES * per_batch).write.parquet(path)
    stream_contacts(read_page_stream(spark, path, per_batch), CFG, sink, state, **options).awaitTermination()
    return sink


def _known_batches(spark, label, pages, batch, start) -> str:
    """A stream whose batches 0, 1, 2 hold the pages of that ``batch``, in any number of files.

    It is resumed whenever pages have arrived: a run takes all new files as one batch.
    """
    path, sink, state = (_scratch(spark, f"{label}-{part}") for part in ("files", "sink", "state"))
    for i in range(STREAM_BATCHES):
        pages.where(batch == i).write.mode("append").parquet(path)
        start(read_page_stream(spark, path, files_per_batch=1_000_000), CFG, sink, state).awaitTermination()
    return sink


def _site_stream(spark, sf) -> str:
    """Pages of the supplier sites, those of one site in three batches: about pages first, for every other site contact pages."""
    pages = materialize(r.site_pages(spark, sf), "site-pages")
    site = F.floor(F.col("page_id") / 3)
    kind = F.col("page_id") % 3
    batch = F.when(kind == 2, 0).when((kind == 1) == (site % 2 == 0), 1).otherwise(2)
    start = partial(stream_sites, partitions=spark.sparkContext.defaultParallelism)
    return _known_batches(spark, "site", pages, batch, start)


def _st1_sites(spark, sf):
    return latest_sites(spark, _site_stream(spark, sf)).drop("page_id")


SITE_NAMED = f"""
select {r.ROOT} || '/' as url, {r.SITE_NAME} as company_name, cast(null as varchar) as contact_person,
       cast(null as varchar) as position, {r.C_EMAIL} as email, {r.A_PHONE} as phone, {r.F_COUNTRY} as country,
       {r.F_STATE} as state, {r.F_CITY} as city, 'ring' as products
from {r.SITE_FROM} where {r.FITS} and not ({r.SHOP})
"""


def _st4_sites(spark, sf):
    rows = finalize_sites(spark, _site_stream(spark, sf))
    return rows.toDF(*[c.lower().replace(" ", "_") for c in rows.columns])


# names that resemble the one of the site before them go, unless that site does not fit
ST4_SITES_SQL = f"""
with n as ({SITE_NAMED}), f as (select n.*, s_suppkey from n join supplier on n.url = {r.ROOT} || '/')
select company_name, coalesce(contact_person, 'Not Found') as contact_person, coalesce(position, 'Not Found') as position,
       coalesce(state, 'Not Found') as state, coalesce(city, 'Not Found') as city, coalesce(country, 'Not Found') as country,
       coalesce(phone, 'Not Found') as phone_number, coalesce(email, 'Not Found') as email, url as website, products
from f where s_suppkey % 16 <> 15 or s_suppkey - 1 not in (select s_suppkey from f)
"""


def _st1(spark, sf):
    from siteroster.registry.extraction import E10_PAGES_COLUMNS

    return spark.read.parquet(_streamed(spark, sf)).select(*E10_PAGES_COLUMNS)


def _st2(spark, sf):
    sink = _streamed(spark, sf, unique_domains=True, partitions=spark.sparkContext.defaultParallelism)
    rows = spark.read.parquet(sink).groupBy(extract_domain("url").alias("domain"))
    return rows.agg(F.count("*").alias("n_rows"))


ST2_SQL = """
select distinct lower(regexp_replace(regexp_extract(url, '://([^/?#:]*)', 1), '^www\\.', '')) as domain, 1 as n_rows
from pages
"""


def _st3(spark, sf):
    """Counts after each batch, of a stream whose batches hold known pages."""
    pages = materialize(table(spark, sf, "pages"), "third-pages")
    start = partial(stream_contacts, total=pages.count())
    sink = _known_batches(spark, "third", pages, F.col("page_id") % STREAM_BATCHES, start)
    return live_snapshot(spark, sink, pages.count())


ST3_SQL = """
with e as ({pages}), c as (
  select page_id % 3 as batch_id, count(*) as n, count(coalesce(email, phone, country)) as f from e group by 1)
select batch_id::int as batch_id, (sum(n) over (order by batch_id))::bigint as completed,
  (sum(f) over (order by batch_id))::bigint as found, (select count(*) from pages) as total
from c
"""


def _st4(spark, sf):
    rows = finalize(spark, _streamed(spark, sf), drop_duplicates=False)
    return rows.select(F.col("Website").alias("website"), F.col("Email").alias("email"), F.col("Company Name").alias("company"))


def _st4_unique(spark, sf):
    """All hosts of the page table give the same name: one row is left."""
    rows = finalize(spark, _streamed(spark, sf))
    return rows.select(F.col("Company Name").alias("company"), F.col("State").alias("state"))


ENTRIES: dict[str, Entry] = {
    "j1_find_subpage": (_j1, J1_SQL),
    "j2_probe_subpage": (_j2, J2_SQL),
    "j3_fill_from_pages": (_j3, J3_SQL),
    "j4_fill_from_model": (_j4, J4_SQL),
    "j5_check_phone_country": (_j5, J5_SQL),
    "j7_similar_name_pairs": (_j7, J7_SQL),
    "d4_dedup_similar_names": (_d4, D4_SQL),
    "d4_dedup_near_copies": (_d4_copies, D4_COPIES_SQL),
    "d5_deduplicate": (_d5, D5_SQL),
    "e11_build_directory": (_e11, E11_SQL),
}


def _stream_entries() -> dict[str, Entry]:
    from siteroster.registry.extraction import E10_PAGES_SQL

    # the other columns of the output are checked by the entry for sites
    emails = f"with e as ({E10_PAGES_SQL}) select url as website, coalesce(email, 'Not Found') as email, company_name as company from e"
    return {
        "st1_stream_contacts": (_st1, E10_PAGES_SQL),
        "st1_stream_sites": (_st1_sites, SITE_NAMED),
        "st2_stream_dedup_domain": (_st2, ST2_SQL),
        "st4_finalize_sites": (_st4_sites, ST4_SITES_SQL),
        "st3_live_snapshot": (_st3, ST3_SQL.format(pages=E10_PAGES_SQL)),
        "st4_partial_result": (_st4, emails),
        "st4_finalize": (_st4_unique, "select 'Example' as company, 'Not Found' as state"),
    }


ENTRIES.update(_stream_entries())
