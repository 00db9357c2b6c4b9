"""Sources, run history, gap filling, the directory and streams."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.config import DirectoryConfig
from siteroster.operators.fill import (
    check_phone_country,
    fill_from_model,
    fill_from_pages,
    find_subpage,
    prefix_dimension,
    probe_subpage,
)
from siteroster.operators.html import parse_pages
from siteroster.operators.jsonld import page_jsonld
from siteroster.functions.patterns import pattern_groups
from siteroster.operators.profile import column_profile, run_funnel
from siteroster.operators.ranking import dedup_domain, merge_results
from siteroster.plans.contacts import contact_columns, extract_contacts
from siteroster.plans.directory import build_directory, visit, wanted_sites
from siteroster.registry import rendered
from siteroster.session import checkpoint_root, materialize
from siteroster.sources.output import to_output, write_directory
from siteroster.sources.pages import read_pages
from siteroster.sources.results import read_result_lists, usable_cache, write_search_results
from siteroster.sources.runs import (
    append_run,
    committed_ids,
    get_run,
    list_runs,
    read_run_results,
    read_runs,
    run_config,
    run_results,
)
from siteroster.sources.words import read_word_list
from siteroster.streaming.contacts import (
    finalize,
    live_snapshot,
    read_page_stream,
    stream_contacts,
)
from tests.test_html import pages

SF = "/root/testdata/sf0.001"
CONFIG = rendered.CONFIG


def test_result_lists_from_json_files(spark, tmp_path):
    lists = {
        "cssd-africa": [{"title": "A", "url": "https://a.org"}, {"title": "B", "url": "https://b.org"}],
        "empty": [],
        "gowns": [{"title": "A", "url": "https://other.org"}],
    }
    for slug, rows in lists.items():
        (tmp_path / f"{slug}.json").write_text(json.dumps(rows, indent=2))
    got = read_result_lists(spark, str(tmp_path / "*.json")).orderBy("query_slug", "rank").collect()
    assert [(r.query_slug, r.title, r.url) for r in got] == [
        ("cssd-africa", "A", "https://a.org"), ("cssd-africa", "B", "https://b.org"),
        ("gowns", "A", "https://other.org"),
    ]


def test_cache_is_all_or_nothing(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, "Query One", 0, "A", "u1"), (1, "query two", 0, "B", "u2")],
        "query_pos int, query string, rank int, title string, url string")
    path = str(tmp_path / "cache")
    write_search_results(rows, path, "h")
    stored = spark.read.parquet(path)
    assert usable_cache(stored, ["query one", "Query two"], "h").count() == 2
    assert usable_cache(stored, ["query one"], "h").count() == 1
    assert usable_cache(stored, ["query one", "query three"], "h").count() == 0
    assert usable_cache(stored, ["query one"], "other").count() == 0


def test_runs(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame(
        [(1, None, '{"search_queries": ["a", "b"], "max_search_pages": 3}', 2, "completed", None),
         (2, None, '{"search_queries": ["' + "x" * 81 + '"]}', 0, "failed", "boom"),
         (3, None, "{}", 0, "cancelled", None)],
        "id bigint, timestamp timestamp, config_json string, num_results int, status string, error_message string")
    rows = spark.createDataFrame([(1, "0115"), (1, "0222")], "run_id bigint, phone string")
    append_run(root, runs.where("id < 3"), rows)
    append_run(root, runs, rows)
    stored = read_runs(spark, root)
    assert stored.count() == 3
    results = read_run_results(spark, root)
    assert sorted(r.phone for r in run_results(results, 1).collect()) == ["0115", "0222"]
    listed = list_runs(stored).collect()
    assert [(r.ID, r.Queries) for r in listed] == [(3, ""), (2, "x" * 77 + "..."), (1, "a; b")]
    assert [r.ID for r in list_runs(stored, 2).collect()] == [3, 2]
    assert get_run(stored, 2).first().error_message == "boom"
    assert run_config(stored, 1, "max_search_pages int").first().max_search_pages == 3
    with pytest.raises(Exception, match="Run 9 not found"):
        get_run(stored, 9).collect()


def test_an_append_that_failed_halfway_is_not_read_and_replays_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    schema = "id bigint, timestamp timestamp, config_json string, num_results int, status string, error_message string"
    runs = spark.createDataFrame([(i, None, "{}", 1, "completed", None) for i in range(200)], schema)
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "run_id bigint, phone string")
    append_run(root, runs.where("id < 50"), rows.where("run_id < 50"))
    for broken in ("runs", "committed"):
        # the results, then also the runs are written, and the append ends before its commit
        path = tmp_path / broken
        moved = path.rename(tmp_path / f"{broken}-aside")
        path.write_text("in the way")
        with pytest.raises(Exception):
            append_run(root, runs, rows)
        path.unlink()
        moved.rename(path)
        assert read_runs(spark, root).count() == read_run_results(spark, root).count() == 50
    append_run(root, runs, rows)
    append_run(root, runs, rows)
    assert read_runs(spark, root).count() == 200
    assert sorted(r.phone for r in read_run_results(spark, root).collect()) == sorted(f"p{i}" for i in range(200))


def test_an_append_reads_its_own_buckets_of_the_manifest(spark, tmp_path):
    root = str(tmp_path)
    schema = "id bigint, timestamp timestamp, config_json string, num_results int, status string, error_message string"
    runs = spark.createDataFrame([(i, None, "{}", 1, "completed", None) for i in range(300)], schema)
    append_run(root, runs, runs.selectExpr("id as run_id"))
    done = committed_ids(spark, root, runs.where("id in (7, 900)").select("id"))
    assert [r.id for r in done.collect()] == [7]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and len(list((tmp_path / "committed").glob("bucket=*"))) > 10


def test_a_funnel_reads_its_source_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(100).write.parquet(path)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    source = spark.read.parquet(path).mapInArrow(count, "id long")
    steps = {"all": lambda rows: rows, "even": lambda rows: rows.where("id % 2 = 0"), "tens": lambda rows: rows.where("id % 10 = 0")}
    assert [tuple(r) for r in run_funnel(source, steps).orderBy("stage_pos").collect()] == [(0, "all", 100), (1, "even", 50), (2, "tens", 10)]
    assert reads.value == 100


def test_a_bad_pattern_fails_when_the_plan_is_built(spark):
    assert pattern_groups(r"(a)(?:b)(?<name>c)") == 2
    with pytest.raises(ValueError, match="not valid"):
        contact_columns(DirectoryConfig.sample(phone_patterns=(r"\d{3", )))
    with pytest.raises(ValueError, match="not valid"):  # fine in Python, not where it runs
        pattern_groups("(?P<digits>[0-9]+)")


def test_word_list(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("Street\n\n Road \n")
    assert sorted(read_word_list(spark, str(path))) == ["Road", "Street"]


def test_output_columns_and_sentinels(spark, tmp_path):
    names = ["company_name", "contact_person", "position", "state", "city", "country", "phone",
             "email", "url", "products"]
    rows = spark.createDataFrame(
        [(None,) * 8 + ("https://www.acme.org/x",) + (None,)], ", ".join(f"{n} string" for n in names))
    out = to_output(rows)
    assert out.columns == fv.OUTPUT_COLUMNS
    assert list(out.first()) == ["Acme"] + ["Not Found"] * 7 + ["https://www.acme.org/x", ""]
    write_directory(out, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    profile = {r.column_name: r for r in column_profile(out).collect()}
    assert (profile["Website"].width, profile["City"].not_found, profile["Products"].max_len) == (25, 1, 8)


def test_checkpoint_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert checkpoint_root(spark) == named
    assert materialize(spark.range(3), "t").count() == 3


def test_rankings_use_a_map_side_limit(spark):
    results = spark.createDataFrame(
        [(1, 0, "A", "u1"), (0, 5, "A", "u2"), (0, 6, "B", "u3")],
        "query_pos int, rank int, title string, url string")
    merged = merge_results(results)
    assert sorted((r.title, r.url) for r in merged.collect()) == [("A", "u2"), ("B", "u3")]
    for table in (merged, dedup_domain(results, ["query_pos", "rank"])):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2


def test_usable_results(spark):
    rows = spark.createDataFrame(
        [(0, 0, " Home Page ", "https://a.org"), (0, 1, "A", "https://facebook.com/a"),
         (0, 2, "A", "https://a.org"), (0, 3, "B", "https://b.org/x.pdf"), (0, 4, "C", "https://c.org")],
        "query_pos int, rank int, title string, url string")
    # the first row of a title decides, even when its URL is unusable
    assert [r.title for r in wanted_sites(rows).collect()] == ["C"]


def test_subpage_patterns(spark):
    htmls = [
        "<a href='/contact'>Contact</a><a href='https://s.org/contact'>Contact</a>",
        "<a href='https://s.org/x'>CONTACT us</a>",
        "<a href='https://s.org/about'>x</a><a href='https://s.org/y'>reach us</a>",
        "<a href='https://x.com/contact'>Contact</a><a href='https://s.org/reachus'>z</a>",
        "<a href='https://s.org/reach-us'><b>Contact</b></a>",
    ]
    found = find_subpage(parse_pages(pages(spark, *htmls)), ["contact", "reach us"])
    got = [r.subpage_url for r in found.orderBy("page_id").collect()]
    assert got == [None, "https://s.org/x", "https://s.org/y", "https://s.org/reachus", "https://s.org/reach-us"]


def test_probe_takes_the_first_keyword(spark):
    known = spark.createDataFrame(
        [("https://a.org/about",), ("https://a.org/our-story",), ("https://b.org/about/x",),
         ("https://c.org/About",)], "url string")
    sites = spark.createDataFrame(
        [(1, "https://a.org/home"), (2, "https://b.org"), (3, "https://c.org/"), (4, "ftp://d")], "page_id bigint, url string")
    got = probe_subpage(sites, ["our story", "about"], known).orderBy("page_id").collect()
    assert [r.probe_url for r in got] == ["https://a.org/our-story", None, None, None]


FIELDS = "email string, phone string, country string, state string, city string, contact_person string, position string"


def test_about_link_comes_from_the_visited_contact_page(spark):
    sites = spark.createDataFrame(
        [(1, "https://a.org", None, "p", None, None, None, None, None, "https://a.org/c", "https://a.org/home-about"),
         (2, "https://b.org", None, "p", None, None, None, None, None, "https://b.org/gone", "https://b.org/home-about"),
         (3, "https://c.org", "e", "p", None, None, None, None, None, "https://a.org/c", None)],
        f"page_id bigint, url string, {FIELDS}, contact_url string, about_url string")
    extracted = spark.createDataFrame(
        [(10, "https://a.org/c", None, "other", "Kenya", None, None, "Eva Strand", None, "https://a.org/about2"),
         (11, "https://a.org/about2", "about2@a.org", None, None, None, "Accra", "Olga Holm", "CEO", None),
         (12, "https://a.org/home-about", "wrong@a.org", None, None, None, None, None, None, None),
         (13, "https://b.org/home-about", "right@b.org", None, None, "S", None, "Olga Holm", "CEO", None)],
        f"page_id bigint, url string, {FIELDS}, about_link string")
    got = {r.page_id: r for r in fill_from_pages(sites, extracted).collect()}
    assert (got[1].email, got[1].phone, got[1].country, got[1].city) == ("about2@a.org", "p", "Kenya", "Accra")
    assert (got[1].contact_person, got[1].position) == ("Eva Strand", None)
    assert (got[2].email, got[2].state, got[2].position) == ("right@b.org", "S", "CEO")
    assert (got[3].email, got[3].country) == ("e", None)


def test_model_fills_only_gaps(spark):
    rows = spark.createDataFrame(
        [(1, "e", None, None, "s", "c", None), (2, "e", "p", "k", "s", "c", None)],
        "page_id bigint, email string, phone string, country string, state string, city string, company_name string")
    model = spark.createDataFrame(
        [(1, "x", " 123 ", " ", "y", "z", "Co", "prod"), (2, "x", "x", "x", "x", "x", "Co", "prod")],
        "page_id bigint, email string, phone string, country string, state string, city string, company_name string, products string")
    got = {r.page_id: tuple(r)[1:] for r in fill_from_model(rows, model).collect()}
    assert got == {1: ("e", "123", None, "s", "c", "Co"), 2: ("e", "p", "k", "s", "c", None)}


def test_longest_prefix_decides(spark):
    rows = spark.createDataFrame(
        [(1, "+27 11", "X"), (2, "+2711 5", None), (3, None, "X"), (4, "0115", "X"), (5, "+1 5", "X")],
        "page_id bigint, phone string, country string")
    prefixes = spark.createDataFrame(
        [("+27", "South Africa"), ("2", "Two"), ("+27115", "Long"), ("+1", "B"), ("+1", "A")], "prefix string, country string")
    got = {r.page_id: r.country for r in check_phone_country(rows, prefixes).collect()}
    assert got == {1: "South Africa", 2: None, 3: "X", 4: "X", 5: "X"}  # two owners: left as it is
    assert prefix_dimension(prefixes).count() == 4


def test_very_many_prefixes_in_one_lookup(spark):
    """200,000 prefixes of 1 to 9 digits against a plain search for the longest one."""
    rng = random.Random(1)
    owners = {}
    for _ in range(200_000):
        owners.setdefault("".join(rng.choice("0123456789") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9]))), f"C{rng.randint(0, 99)}")
    numbers = [(i, "+" + "".join(rng.choice("0123456789") for _ in range(rng.randint(0, 14))), "X") for i in range(3000)]
    numbers += [(5000 + i, "+" + p, "X") for i, p in enumerate(list(owners)[:500])]
    few = {p: c for p, c in owners.items() if len(p) != 2}

    def longest(phone, table):
        return next((table[phone[1:n + 1]] for n in range(9, 0, -1) if len(phone) > n and phone[1:n + 1] in table), "X")

    rows = spark.createDataFrame(numbers, "page_id bigint, phone string, country string")
    for table in (owners, few, {}):
        prefixes = spark.createDataFrame([(f"+{p}", c) for p, c in table.items()], "prefix string, country string")
        checked = check_phone_country(rows, prefixes)
        assert checked._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
        assert {r.page_id: r.country for r in checked.collect()} == {i: longest(p, table) for i, p, _ in numbers}


def test_directory_without_options_and_with_nothing(spark):
    out = build_directory(rendered.site_results(spark, SF), rendered.site_pages(spark, SF), CONFIG)
    assert out.columns == fv.OUTPUT_COLUMNS and out.count() > 5
    none = rendered.site_results(spark, SF).where("false")
    assert build_directory(none, rendered.site_pages(spark, SF), CONFIG).count() == 0


def test_directory_does_not_depend_on_partitions(spark):
    results, site_pages = rendered.site_results(spark, SF), rendered.site_pages(spark, SF)
    one = build_directory(results, site_pages, CONFIG)
    other = build_directory(results.repartition(5), site_pages.repartition(3, F.rand(1)), CONFIG)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_stream_equals_batch_and_replays_add_nothing(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    table = read_pages(spark, f"{SF}/pages.parquet")
    table.repartition(3).write.parquet(source)
    seen = []

    def run(state):
        query = stream_contacts(
            read_page_stream(spark, source, 1), CONFIG, sink, str(tmp_path / state),
            on_progress=lambda i, rows: seen.append((i, rows.count())))
        query.awaitTermination()

    run("state")
    batch = extract_contacts(table, CONFIG)
    stored = spark.read.parquet(sink).select(batch.columns)
    assert stored.exceptAll(batch).count() == 0 and stored.count() == batch.count()
    assert seen[-1] == (2, table.count())
    snapshot = live_snapshot(spark, sink, 10).orderBy("batch_id").collect()
    assert [r.completed for r in snapshot] == [n for _, n in seen]
    run("state")  # nothing new
    run("lost-state")  # every batch again
    assert spark.read.parquet(sink).count() == table.count()
    assert finalize(spark, sink, drop_duplicates=False).count() == table.count()


def test_probing_reads_only_urls(spark, tmp_path):
    from siteroster.operators.fill import probe_table

    path = str(tmp_path / "pages")
    spark.createDataFrame(
        [(1, "https://a.org/contact", None), (2, "https://a.org/", "<p>x</p>")],
        "page_id bigint, url string, html string").write.parquet(path)
    known = read_pages(spark, path, fetched_only=False).select("url")
    plan = probe_table(known, ["contact"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<url:string>" in plan
    assert read_pages(spark, path).count() == 1


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_repeated_predictions_fill_one_row(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None)], "page_id long, email string, phone string, country string, state string, city string")
    rows = rows.withColumn("company_name", F.lit(None).cast("string"))
    model = spark.createDataFrame([(1, "b@x.it", "Rome"), (1, "a@x.it", None), (1, "a@x.it", None)], "page_id long, email string, city string")
    for name in ("phone", "country", "state", "company_name"):
        model = model.withColumn(name, F.lit(None).cast("string"))
    # by the fields in their order, given values before missing ones: the city decides
    assert [r.email for r in fill_from_model(rows, model).collect()] == ["b@x.it"]


def test_first_copy_of_a_page_is_visited(spark):
    pages = spark.createDataFrame([(2, "u", "second"), (1, "u", "first"), (3, "v", None), (0, "u", None)], "page_id long, url string, html string")
    urls = spark.createDataFrame([("u",), ("u",), ("v",)], "url string")
    assert [r.html for r in visit(pages, urls).collect()] == ["first"]


def test_repeated_json_ld_keys(spark):
    html = '<script type="application/ld+json">{"name": "A", "name": "B"}</script>'
    page = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert [r.item for r in page_jsonld(parse_pages(page)).collect()] == ['{"name":"B"}']
