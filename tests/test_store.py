"""Visits of a bucketed page store, and the wanted-URL bitmap."""

from __future__ import annotations

import re
import uuid

import pytest

from siteroster.plans.directory import fetched_pages, visit
from siteroster.session import materialize, session_settings
from siteroster.sources.store import may_be_wanted, read_page_store, write_page_store

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def pages(spark):
    rows = [(i, f"https://site{i % 400}.org/{i % 3}", None if i % 11 == 0 else f"<p>{i}</p>" * 20) for i in range(3000)]
    return materialize(spark.createDataFrame([*rows, (9000, None, "<p>x</p>")], "page_id bigint, url string, html string"), "store-test")


def wanted(spark, n=60):
    return spark.createDataFrame([(f"https://site{i}.org/{i % 3}",) for i in range(n)] + [("https://none.org/",)] * 3, "url string")


def first_pages(pages, urls):
    listed, found = {r.url for r in urls.collect()}, {}
    for r in pages.collect():
        if r.html is not None and r.url in listed:
            found[r.url] = min(found.get(r.url, r.page_id), r.page_id)
    return sorted((p, u) for u, p in found.items())


def steps_above(plan, scanned):
    """Lines of the plan between its top and the scan that reads ``scanned``."""
    lines = plan.splitlines()
    depth = lambda line: re.search(r"[A-Za-z*]", line).start()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and scanned in line.split("ReadSchema")[1])
    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            found.append(line)
            level = depth(line)
    return found


def test_visits_are_the_same_with_and_without_a_broadcast(spark, pages):
    urls = wanted(spark)
    want = first_pages(pages, urls)
    assert want and sorted((r.page_id, r.url) for r in visit(pages, urls).collect()) == want
    with session_settings(spark, NO_BROADCAST):
        assert sorted((r.page_id, r.url) for r in visit(pages, urls, fetched_pages(pages)).collect()) == want


def test_a_large_list_filters_html_before_the_shuffle(spark, pages):
    urls = wanted(spark)
    with session_settings(spark, NO_BROADCAST):
        plan = visit(pages, urls)._jdf.queryExecution().executedPlan().toString()
    names = [re.search("BroadcastHashJoin|SortMergeJoin|Exchange|$", line)[0] for line in steps_above(plan, "html:string")]
    # from the scan up: bitmap test, then the exchange, then the join
    assert [n for n in names if n] == ["BroadcastHashJoin", "Exchange", "SortMergeJoin"]
    kept = may_be_wanted(pages, urls)
    exact = pages.join(urls, "url", "left_semi").select(pages.columns)
    assert exact.exceptAll(kept).count() == 0 and kept.count() <= exact.count() + 2


def test_a_page_store_is_never_shuffled(spark, pages):
    name = f"pages_{uuid.uuid4().hex}"
    write_page_store(pages, name, buckets=8)
    try:
        stored, urls = read_page_store(spark, name), wanted(spark)
        assert stored.count() == pages.where("url is not null").count()
        fetched = fetched_pages(stored)
        with session_settings(spark, {**NO_BROADCAST, "spark.sql.adaptive.enabled": "false"}):
            visited = visit(stored, urls, fetched)
            plan = visited._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.page_id, r.url) for r in visited.collect()) == first_pages(pages, urls)
        assert "Bucketed: true" in plan
        above = steps_above(plan, "html:string")
        assert any("SortMergeJoin" in line for line in above) and not any("Exchange" in line for line in above)
    finally:
        spark.sql(f"drop table if exists {name}")
