"""Streams with keyed state: sites whose pages arrive in any batch, first rows of domains, progress."""

from __future__ import annotations

import itertools
from pathlib import Path

from siteroster.config import DirectoryConfig
from siteroster.session import session_settings
from siteroster.streaming.contacts import live_snapshot, read_page_stream, stream_contacts
from siteroster.streaming.sites import finalize_sites, latest_sites, stream_sites

CONFIG = DirectoryConfig.sample(
    countries=("Kenya", "Ghana"), contact_keywords=("contact", "reach us"), product_categories=("ring", "gizmo"))
FIT = "<p>ring manufacturer of gizmo</p>"


def site(name, first_id, link=True):
    """Home without mail or phone, contact page with mail and a link to the about page, which has the phone."""
    root = f"https://www.{name}.org"
    home = FIT + (f'<a href="{root}/c">Contact</a>' if link else "")
    contact = f'<p>info@{name}.org</p>\n<p>City: Accra.</p>\n<a href="{root}/us">About</a>'
    about = "<p>Tel: +27115123456</p>\n<p>Kenya</p>"
    return [(first_id, f"{root}/", home), (first_id + 1, f"{root}/{'c' if link else 'reach-us'}", contact), (first_id + 2, f"{root}/us", about)]


def run(spark, tmp_path, batches, name="x", start=stream_sites, **options):
    source, sink = str(tmp_path / f"in-{name}"), str(tmp_path / f"sink-{name}")
    for batch in batches:
        spark.createDataFrame(batch, "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(source)
    start(read_page_stream(spark, source, 1), CONFIG, sink, str(tmp_path / f"state-{name}"), **options).awaitTermination()
    return sink


def test_pages_of_a_site_in_any_order_of_batches(spark, tmp_path):
    orders = list(itertools.permutations(range(3)))
    sites = [site(f"mercantile{i}", 10 * i, i % 2 == 0) for i in range(6)]
    batches = [[sites[i][order[b]] for i, order in enumerate(orders)] for b in range(3)]
    # a copy of a home page that arrives later, a page of another site, a shopless home that does not fit, a page without URL
    batches[2] += [(900, "https://www.mercantile0.org/", FIT + "<p>late@mercantile0.org</p>"), (901, "https://other.net/c", "<p>x@other.net</p>"),
                   (902, "https://plain.org/", "<p>nothing</p>"), (903, None, FIT)]
    seen = []
    sink = run(spark, tmp_path, batches, on_metrics=seen.append, total=22)
    rows = {r.url: r for r in latest_sites(spark, sink).collect()}
    assert set(rows) == {f"https://www.mercantile{i}.org/" for i in range(6)}
    for i in range(6):
        r = rows[f"https://www.mercantile{i}.org/"]
        assert (r.page_id, r.email, r.phone, r.city, r.country, r.products) == (
            10 * i, f"info@mercantile{i}.org", "+27115123456", "Accra", "Kenya", "ring, gizmo")
    assert [p.batch_id for p in seen] == [0, 1, 2] and seen[-1].total == 22
    assert seen[-1].completed == spark.read.parquet(sink).count() == sum(p.rows for p in seen)
    snapshot = live_snapshot(spark, sink, 22).orderBy("batch_id").collect()
    assert [(r.completed, r.found) for r in snapshot] == [(p.completed, p.found) for p in seen]
    assert finalize_sites(spark, sink, drop_duplicates=False).count() == 6
    # the names "Mercantile 0" ... "Mercantile 5" are alike: one stays
    assert [r["Website"] for r in finalize_sites(spark, sink).collect()] == ["https://www.mercantile0.org/"]


def test_first_row_of_a_domain_over_batches(spark, tmp_path):
    batches = [[(5, "https://a.org/x", "<p>five@a.org</p>"), (3, "https://www.a.org/y", "<p>three@a.org</p>"), (9, None, "<p>x</p>")],
               [(1, "http://A.org/", "<p>one@a.org</p>"), (2, "https://b.org/", "<p>two@b.org</p>"), (8, None, "<p>y</p>")]]
    plans = []

    def first(pages, *where, **options):
        return stream_contacts(pages, *where, unique_domains=True, on_metrics=plans.append, **options)

    sink = run(spark, tmp_path, batches, "first", first)
    assert {(r.page_id, r.email, r.batch_id) for r in spark.read.parquet(sink).collect()} == {
        (3, "three@a.org", 0), (9, None, 0), (2, "two@b.org", 1)}
    assert [(p.rows, p.completed, p.found) for p in plans] == [(2, 2, 1), (1, 3, 2)]


def test_a_batch_of_one_file_is_read_by_many_tasks(spark, tmp_path):
    pages = [(i, f"https://f{i}.org/", f"<p>mail@f{i}.org</p>") for i in range(64)]
    sink = run(spark, tmp_path, [pages], "one", stream_contacts)
    # a task leaves a file
    assert len(list(Path(sink, "batch_id=0").glob("*.parquet"))) > 1
    rows = spark.read.parquet(sink).collect()
    assert {(r.page_id, r.email) for r in rows} == {(i, f"mail@f{i}.org") for i in range(64)} and len(rows) == 64


def test_pages_of_a_site_stream_are_dealt_before_they_are_read(spark, tmp_path, capsys):
    queries = []

    def start(*where, **options):
        queries.append(stream_sites(*where, **options))
        return queries[0]

    run(spark, tmp_path, [site("mercantile", 1)], "dealt", start)
    queries[0].explain()
    plan = capsys.readouterr().out
    # the plan is printed from the last step to the first: the pages meet by site, were parsed, and were dealt before that
    assert 0 < plan.index("TransformWithState") < plan.index("MapInArrow") < plan.rindex("RoundRobinPartitioning")


def test_settings_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with session_settings(spark, {key: "x", "spark.own.key": "1"}):
        assert spark.conf.get(key) == "x"
    assert spark.conf.get(key) == before and spark.conf.get("spark.own.key", None) is None
