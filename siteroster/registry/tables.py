"""URL and title filters, ranking, profiles, sources and run history over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.email import normalize_email
from siteroster.functions.urls import query_slug
from siteroster.operators.filters import (
    drop_generic_titles,
    filter_search_urls,
    filter_site_urls,
    filter_visit_urls,
    has_gaps,
    relevance,
    search_frontier,
)
from siteroster.operators.profile import (
    column_profile,
    contact_completeness,
    funnel,
    run_funnel,
    results_per_query,
)
from siteroster.operators.ranking import dedup_domain, first_valid, merge_results
from siteroster.registry import rendered as r
from siteroster.registry.base import Entry, choose, sql_list, table
from siteroster.session import checkpoint_root
from siteroster.sources.output import to_output, write_directory
from siteroster.sources.results import (
    read_result_lists,
    read_search_results,
    usable_cache,
    write_search_results,
)
from siteroster.sources.runs import (
    append_run,
    get_run,
    list_runs,
    read_run_results,
    read_runs,
    run_config,
    run_results,
)

EXCLUDED = ["spam-farm", "cheap-pills"]
URL_RAW = choose("page_id", [
    "url", "replace(url, 'example', 'google')", "url || '.pdf'", "replace(url, 'http', 'ftp')",
    "replace(url, '://', '://x.com/')", "replace(url, '.example.', '.facebook.')",
    "replace(url, '.example.', '.LinkedIn.')", "url || '.PDF'", "replace(url, '.example.', '.YouTube.')",
])


def _scratch(spark, label: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.expr(URL_RAW).alias("url"))


def _p1(spark, sf):
    return filter_search_urls(_urls(spark, sf), EXCLUDED)


RAW_CTE = f"with r as (select page_id, {URL_RAW} as url from pages)"
P1_SQL = f"""
{RAW_CTE} select page_id, url from r
where not regexp_matches(lower(url), 'google\\.com|google\\.co|youtube\\.com|spam-farm|cheap-pills')
"""


def _p2(spark, sf):
    return filter_visit_urls(_urls(spark, sf))


P2_SQL = f"""
{RAW_CTE} select page_id, url from r
where regexp_matches(url, '^https?://') and not contains(url, 'google.com/search')
  and not regexp_matches(url, '(^|://)(www\\.)?(facebook|twitter|x)\\.com/') and not ends_with(url, '.pdf')
"""


def _p3(spark, sf):
    return filter_site_urls(_urls(spark, sf))


P3_SQL = f"""
{RAW_CTE}, h as (select *, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host from r)
select page_id, url from h
where regexp_matches(url, '^https?://')
  and not regexp_matches(host, '(^|\\.)(facebook|twitter|x|linkedin|instagram)\\.com$')
"""


def _p4(spark, sf):
    return drop_generic_titles(r.search_results(spark, sf)).select("rank", "title")


P4_SQL = f"""
with {r.SEARCH_CTE} select rank, title from r where lower(trim(title)) not in ({sql_list(fv.GENERIC_TITLES)})
"""

TERMS = ["the", "there", "quell", "sterile", "Ist "]


def _p5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return relevance(docs, TERMS).select("doc_id", "score")


P5_SQL = f"""
with s as (select doc_id, cast(list_sum(list_transform([{sql_list([t.lower() for t in TERMS] + fv.MAKER_TERMS)}],
                  lambda k: case when contains(lower(text), k) then 1 else 0 end)) as int) as score from documents)
select doc_id, score from s where score >= 2
"""

GAP = {
    "email": "case when c_custkey % 2 = 0 then c_name end",
    "phone": "case when c_custkey % 3 < 2 then c_name end",
    "country": "case when c_custkey % 5 > 0 then 'X' end",
    "state": "case when c_custkey % 7 > 1 then 'S' end",
    "city": "case when c_custkey % 11 > 0 then 'C' end",
}
GAP_SELECT = ", ".join(f"{v} as {k}" for k, v in GAP.items())


def _gap_rows(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", *[F.expr(v).alias(k) for k, v in GAP.items()]
    )


def _p8(spark, sf):
    return has_gaps(_gap_rows(spark, sf)).select("c_custkey")


P8_SQL = f"""
with g as (select c_custkey, {GAP_SELECT} from customer)
select c_custkey from g where email is null or phone is null or country is null or state is null or city is null
"""

QUERY_RAW = "p_name || choose_mark || cast(p_partkey as string)"
MARK = choose("p_partkey", ["' '", "'*'", "'~'", "' & é/'", "'-_.'"])


def _p9(spark, sf):
    queries = table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_pos"),
        F.expr(QUERY_RAW.replace("choose_mark", MARK)).alias("query"),
    )
    return search_frontier(queries, 13, 3).select("query_pos", "attempt", "page_num", "url")


P9_SQL = f"""
with q as (select p_partkey as query_pos, {QUERY_RAW.replace('choose_mark', MARK)} as query from part),
     a as (select q.*, cast(a as int) as attempt, cast(p as int) as page_num
           from q, range(0, 13) x(a), range(1, 4) y(p) where a <> 1 or p = 1),
     t as (select *, case when attempt = 0 then query
                          else query || ' ' || [{sql_list(fv.SEARCH_SUFFIXES)}][(attempt - 2) % 9 + 1] end as txt from a)
select query_pos, attempt, page_num,
       case when attempt = 1 then 'https://www.google.com'
            else 'https://www.google.com/search?q=' || replace(url_encode(txt), '%20', '+')
                 || case when page_num > 1 then '&start=' || (page_num - 1) * 10 else '' end end as url
from t
"""


# ---- ranking ------------------------------------------------------------------
def _d1(spark, sf):
    return merge_results(r.search_results(spark, sf)).select("query_pos", "rank", "title", "url")


D1_SQL = f"""
with {r.SEARCH_CTE}
select query_pos, rank, title, url from r
qualify row_number() over (partition by title order by query_pos, rank) = 1
"""


def _d2(spark, sf):
    words = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")
    )
    judged = words.withColumn("value", F.expr("case when length(word) >= 9 then word end"))
    return first_valid(judged, ["doc_id"], ["pos"])


D2_SQL = """
with w as (select doc_id, string_split(text, ' ') as ws from documents),
     u as (select doc_id, generate_subscripts(ws, 1) as pos, unnest(ws) as word from w)
select doc_id, arg_min(word, pos) as value from u where length(word) >= 9 group by doc_id
"""


def _d2_email(spark, sf):
    tokens = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "token")
    )
    judged = tokens.where(F.col("token").contains("@")).withColumn("value", normalize_email("token"))
    return first_valid(judged, ["doc_id"], ["pos"])


D2_EMAIL_SQL = f"""
with w as (select doc_id, string_split_regex(text, '\\s+') as ws from documents),
     u as (select doc_id, generate_subscripts(ws, 1) as pos, lower(unnest(ws)) as e from w)
select doc_id, arg_min(e, pos) as value from u
where regexp_full_match(e, '{fv.EMAIL_PATTERN}')
  and split_part(e, '@', 2) not in ({sql_list(fv.PLACEHOLDER_DOMAINS)})
  and not regexp_matches(e, '\\.(png|jpg|jpeg|gif|svg|webp|ico|bmp)$')
  and not contains(e, '@2x.') and not contains(e, '@3x.')
group by doc_id
"""

NULL_URL = "case when page_id % 13 = 0 then cast(null as string) else url end"


def _d3(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.expr(NULL_URL).alias("url"))
    return dedup_domain(pages, ["page_id"])


D3_SQL = f"""
with p as (select page_id, {NULL_URL} as url from pages),
     d as (select *, coalesce(lower(regexp_replace(regexp_extract(url, '://([^/?#:]*)', 1), '^www\\.', '')), '') as d from p)
select page_id, url from d qualify row_number() over (partition by d order by page_id) = 1
"""


# ---- profiles -----------------------------------------------------------------
OUT = {
    "Company Name": "c_name", "Contact Person": "'Not Found'", "Position": "'Not Found'",
    "State": "case when c_custkey % 3 = 0 then 'Not Found' else 'North' end",
    "City": "case when c_custkey % 4 = 0 then ' Not Found ' else 'Accra' end",
    "Country": "repeat('x', cast(c_custkey % 90 as int))",
    "Phone Number": "cast(c_custkey as string)", "Email": "c_mktsegment",
    "Website": "cast(null as string)", "Products": "''",
}


def _a1(spark, sf):
    rows = table(spark, sf, "customer").select(*[F.expr(v).alias(k) for k, v in OUT.items()])
    return column_profile(rows)


A1_SQL = " union all ".join(
    f"""select '{k}' as column_name,
    cast(greatest(coalesce(max(length({v})), 0), {len(k)}) as int) as max_len,
    cast(least(greatest(coalesce(max(length({v})), 0), {len(k)}) + 3, 60) as int) as width,
    count(*) filter (where trim({v}) = 'Not Found') as not_found from customer"""
    for k, v in OUT.items()
)


def _a2(spark, sf):
    return contact_completeness(_gap_rows(spark, sf))


A2_SQL = f"""
with g as (select c_custkey, {GAP_SELECT} from customer)
select count(*) as n_rows, count(coalesce(email, phone, country, state, city)) as n_found,
       count(email) as n_email, count(phone) as n_phone, count(country) as n_country,
       count(state) as n_state, count(city) as n_city from g
"""


def _a3(spark, sf):
    return run_funnel(r.search_results(spark, sf), {
        "results": lambda rows: rows, "unique": merge_results, "named": drop_generic_titles, "visited": filter_visit_urls,
        "domains": lambda rows: dedup_domain(rows, ["query_pos", "rank"]),
    })


def _a3_stages(spark, sf):
    results = r.search_results(spark, sf)
    visited = filter_visit_urls(results)
    return funnel({"results": results, "visited": visited})


A3_STAGES_SQL = f"""
with {r.SEARCH_CTE}, v as (select * from r where regexp_matches(url, '^https?://') and not ends_with(url, '.pdf'))
select 0 as stage_pos, 'results' as stage, count(*) as n_rows from r union all select 1, 'visited', count(*) from v
"""


A3_SQL = f"""
with {r.SEARCH_CTE},
     u as (select * from r qualify row_number() over (partition by title order by query_pos, rank) = 1),
     n as (select * from u where lower(trim(title)) not in ({sql_list(fv.GENERIC_TITLES)})),
     v as (select * from n where regexp_matches(url, '^https?://') and not ends_with(url, '.pdf'))
select 0 as stage_pos, 'results' as stage, count(*) as n_rows from r
union all select 1, 'unique', count(*) from u
union all select 2, 'named', count(*) from n
union all select 3, 'visited', count(*) from v
union all select 4, 'domains', count(distinct lower(regexp_replace(regexp_extract(url, '://([^/?#:]*)', 1), '^www\\.', ''))) from v
"""


def _a4(spark, sf):
    return results_per_query(r.search_results(spark, sf).withColumn("query_slug", query_slug("query")))


A4_SQL = f"""
with {r.SEARCH_CTE} select replace(query, ' ', '-') as query_slug, count(*) as n_results from r group by 1
"""


# ---- sources and sinks -----------------------------------------------------------
def _s2(spark, sf):
    """Fifty results per list, so lists stay small and their number grows."""
    path = _scratch(spark, "result-lists")
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("list-"), F.floor(F.col("page_id") / 50)).alias("query_slug"),
        "page_id", F.col("url"), F.expr(r.H1).alias("title"),
    )
    lists = pages.groupBy("query_slug").agg(
        F.to_json(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_id", "title", "url"))),
                lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url")),
            )
        ).alias("value")
    )
    lists.write.partitionBy("query_slug").text(path)
    return read_result_lists(spark, path)


S2_SQL = f"""
select 'list-' || cast(floor(page_id / 50) as int) as query_slug, {r.H1} as title, url,
    row_number() over (partition by floor(page_id / 50) order by page_id) - 1 as rank from pages
"""


def _s3(spark, sf):
    path = _scratch(spark, "results")
    results = r.search_results(spark, sf)
    write_search_results(results, path, "h1")
    write_search_results(results.where("query <> 'query 5'"), path, "h1")
    write_search_results(results.where("query = 'query 5'"), path, "h2")
    return read_search_results(spark, path).select("config_hash", "query_slug", "rank", "title", "url")


S3_SQL = f"""
with {r.SEARCH_CTE}
select 'h1' as config_hash, replace(query, ' ', '-') as query_slug, rank, title, url from r
union all select 'h2', replace(query, ' ', '-'), rank, title, url from r where query_pos = 5
"""


def _s4(spark, sf):
    stored = r.search_results(spark, sf).select(
        F.when(F.col("query_pos") < 4, "old").otherwise("new").alias("config_hash"),
        query_slug("query").alias("query_slug"), "rank", "title", "url",
    )
    complete = usable_cache(stored, ["Query 1", "query 2", "query 3"], "old")
    partial = usable_cache(stored, ["query 4", "query 99"], "new")
    return complete.unionByName(partial)


S4_SQL = f"""
with {r.SEARCH_CTE}
select 'old' as config_hash, replace(query, ' ', '-') as query_slug, rank, title, url
from r where query_pos in (1, 2, 3)
"""

INNER = {
    "company_name": "case when c_custkey % 4 > 0 then c_name end",
    "url": "'https://www.firm' || cast(c_custkey as string) || '.co.za/x'",
    "contact_person": "case when c_custkey % 3 = 0 then 'Anna Berg' end",
    "position": "cast(null as string)", "state": "case when c_custkey % 5 = 0 then 'North' end",
    "city": "case when c_custkey % 2 = 0 then 'Accra' end", "country": "'Ghana'",
    "phone": "case when c_custkey % 7 > 0 then '0123456789' end", "email": "lower(c_mktsegment)",
    "products": "case when c_custkey % 6 = 0 then 'ring, bolt' end",
}


def _s6(spark, sf):
    rows = table(spark, sf, "customer").select(*[F.expr(v).alias(k) for k, v in INNER.items()])
    path = _scratch(spark, "directory")
    write_directory(to_output(rows), path, "csv")
    schema = ", ".join(f"`{c}` string" for c in fv.OUTPUT_COLUMNS)
    stored = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return stored.select(
        *[F.coalesce(f"`{c}`", F.lit("")).alias(c.lower().replace(" ", "_")) for c in fv.OUTPUT_COLUMNS]
    )


S6_SQL = f"""
with r as (select {', '.join(f'{v} as {k}' for k, v in INNER.items())}, c_custkey from customer)
select coalesce(company_name, 'Firm' || c_custkey) as company_name,
       coalesce(contact_person, 'Not Found') as contact_person, 'Not Found' as position,
       coalesce(state, 'Not Found') as state, coalesce(city, 'Not Found') as city, country,
       coalesce(phone, 'Not Found') as phone_number, email, url as website, coalesce(products, '') as products
from r
"""

RUN_TEXT = "repeat(o_orderpriority || ' ', cast(o_orderkey % 4 as int))"
CONFIG_JSON = f"""'{{"search_queries":["q' || cast(o_orderkey as string) || '","' || {RUN_TEXT} || '","' || {RUN_TEXT} || '"],"max_search_pages":' || cast(o_custkey % 9 as string) || '}}'"""
QUERIES_TEXT = f"'q' || cast(o_orderkey as string) || '; ' || {RUN_TEXT} || '; ' || {RUN_TEXT}"


def _runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.expr(CONFIG_JSON).alias("config_json"),
        (F.col("o_custkey") % 50).cast("int").alias("num_results"),
        F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("error_message"),
    )


def _s7(spark, sf):
    root = _scratch(spark, "runs")
    runs = _runs(spark, sf)
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line")
    )
    finished = runs.where("status <> 'O'")
    done = rows.join(finished.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    append_run(root, finished, done)
    append_run(root, runs, rows)
    stored = read_run_results(spark, root).groupBy("run_id").agg(F.count("*").alias("n_rows"))
    return read_runs(spark, root).join(stored, F.col("id") == F.col("run_id")).select(
        "id", "num_results", "status", "n_rows"
    )


# runs that are not open are offered twice and stored once, their results likewise
S7_SQL = """
select o_orderkey as id, cast(o_custkey % 50 as int) as num_results, o_orderstatus as status, count(*) as n_rows
from orders join lineitem on l_orderkey = o_orderkey group by all
"""


def _s8(spark, sf):
    return list_runs(_runs(spark, sf)).withColumn("Timestamp", F.col("Timestamp").cast("string"))


S8_SQL = f"""
with t as (select o_orderkey as id, o_orderdate as ts, {QUERIES_TEXT} as q, o_custkey % 50 as n, o_orderstatus as s
           from orders order by o_orderkey desc limit 100)
select id as "ID", strftime(ts, '%Y-%m-%d %H:%M:%S') as "Timestamp",
       case when length(q) > 80 then left(q, 77) || '...' else q end as "Queries",
       cast(n as int) as "Results", s as "Status"
from t
"""


def _s9(spark, sf):
    """Newest run: its configuration beside the number of its result rows."""
    runs = _runs(spark, sf)
    run_id = runs.agg(F.max("id")).first()[0]
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    config = run_config(runs, run_id, "search_queries array<string>, max_search_pages int")
    counted = run_results(rows, run_id).agg(F.count("*").alias("n_rows"))
    return get_run(runs, run_id).select(
        "id",
        "status",
        counted.scalar().alias("n_rows"),
        config.select("max_search_pages").scalar().alias("max_search_pages"),
        config.select(F.size("search_queries")).scalar().alias("n_queries"),
    )


S9_SQL = """
select o_orderkey as id, o_orderstatus as status,
       (select count(*) from lineitem where l_orderkey = o_orderkey) as n_rows,
       cast(o_custkey % 9 as int) as max_search_pages, 3 as n_queries
from orders where o_orderkey = (select max(o_orderkey) from orders)
"""

ENTRIES: dict[str, Entry] = {
    "s2_read_search_results": (_s2, S2_SQL),
    "s3_write_search_results": (_s3, S3_SQL),
    "s4_usable_cache": (_s4, S4_SQL),
    "s6_to_output": (_s6, S6_SQL),
    "s7_append_run": (_s7, S7_SQL),
    "s8_list_runs": (_s8, S8_SQL),
    "s9_run_lookup": (_s9, S9_SQL),
    "p1_filter_search_urls": (_p1, P1_SQL),
    "p2_filter_visit_urls": (_p2, P2_SQL),
    "p3_filter_site_urls": (_p3, P3_SQL),
    "p4_drop_generic_titles": (_p4, P4_SQL),
    "p5_relevance": (_p5, P5_SQL),
    "p8_has_gaps": (_p8, P8_SQL),
    "p9_search_frontier": (_p9, P9_SQL),
    "a1_column_profile": (_a1, A1_SQL),
    "a2_contact_completeness": (_a2, A2_SQL),
    "a3_funnel": (_a3, A3_SQL),
    "a3_funnel_of_tables": (_a3_stages, A3_STAGES_SQL),
    "a4_results_per_query": (_a4, A4_SQL),
    "d1_merge_results": (_d1, D1_SQL),
    "d2_first_valid": (_d2, D2_SQL),
    "d2_first_valid_email": (_d2_email, D2_EMAIL_SQL),
    "d3_dedup_domain": (_d3, D3_SQL),
}
