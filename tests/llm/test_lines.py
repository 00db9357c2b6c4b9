"""Line dedup against a plain version and its SQL."""

from __future__ import annotations

import hashlib
import string

import pytest

from siteroster.llm.line_dedup import line_report, line_rows
from siteroster.llm.queries_lines import ENTRIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda doc: (doc is None, doc or 0)
    first: dict[str, tuple] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), order(doc)), order(doc))
    found = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [first.get(key(x), order(doc)) != order(doc) for x in lines]
        words = {}
        for i, g in enumerate(gone):
            if g:
                words[i // 64] = words.get(i // 64, 0) | 1 << i % 64
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        found.append((doc, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(),
                      ",".join(f"{w:X}:{b:X}" for w, b in sorted(words.items()))))
    return sorted(found, key=repr)


def report(docs):
    return sorted((tuple(r) for r in line_report(docs).collect()), key=repr)


def test_against_plain(spark, documents):
    shared = "The same footer line\n" * 2
    rows = [
        (7, "Own first line here\n" + shared + "x"), (3, "\t THE SAME footer LINE \r\nshort\nÄÖÜ äöü äöü 12"),
        (5, "ÄÖÜ äöü äöü 12\nshort\n\n"), (5, "another text of five\nÄÖÜ äöü äöü 12"), (None, shared), (None, "only null rows hold this"),
        (None, "only null rows hold this"), (8, None), (9, ""), (10, "\n\n"), (11, "äÖü äöü äöü 12"), (12, "123456789\n 123456789 "),
        (13, "123456789\n1234567890"), (14, "1234567890"), (7, "Own first line here\n" + shared + "x"),
    ]
    rows += [(100 + i, "\n".join(f"line number {j % (40 + i)} of many" for j in range(150))) for i in range(12)]
    assert report(documents(rows)) == brute(rows)


def test_extra_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame(
        [(1, "a line that is shared", 1, 2, 3, 4), (2, "a line that is shared", 5, 6, 7, 8)],
        "doc_id long, text string, position int, first int, words int, k1 int")
    assert [r.n_dropped for r in line_report(docs).orderBy("doc_id").collect()] == [0, 1]
    assert line_report(docs.limit(0)).collect() == []


def test_a_long_text_and_a_line_of_all_documents(spark, documents):
    long = "\n".join(f"one of the {i % 70_000} many lines" for i in range(100_000))
    rows = [(1, long), (2, long.upper() + "\nits own last line")] + [(i, f"line of every document\nown line {i:09}") for i in range(3, 3000)]
    got = {r[0]: r for r in report(documents(rows))}
    assert got[1][1:3] == (100_000, 0) and got[2][1:3] == (100_001, 100_000)
    assert got[2][3] == hashlib.sha256(b"its own last line").hexdigest()
    assert got[3][2] == 0 and all(got[i][2] == 1 for i in range(4, 3000))


def test_first_pass_deals_a_hot_line_and_adds_no_shuffle(spark, documents):
    from siteroster.llm.line_dedup import _first_of

    rows = line_rows(documents([(i, "line of every document") for i in range(2000)]), 10)
    assert rows.select("share").distinct().count() > 200
    plan = _first_of(rows, ["k1", "k2", "share"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


@pytest.mark.parametrize("name", ENTRIES)
def test_query_equals_sql(spark, name):
    query, sql = ENTRIES[name]
    assert compare(spark, connect(SF), name, query, sql, SF) == ""
