"""Nesting, strings and derived tables of parsed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteroster.operators.html import (
    node_stripped,
    page_containment,
    page_lines,
    page_links,
    page_nodes,
    page_text,
    parse_pages,
    single_string,
    where_nodes,
    with_text,
)
from siteroster.operators.jsonld import jsonld_items, page_jsonld, place_in_items


def pages(spark, *htmls):
    rows = [(i, f"https://s{i}.org/", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def parsed(spark, *htmls):
    return parse_pages(pages(spark, *htmls))


def text_of(spark, html):
    return page_text(parsed(spark, html)).first().text


def test_text_skips_hidden_strings(spark):
    html = (
        "<!DOCTYPE html><title>T</title><!-- c --><style>p{}</style><script>var a='</p>';</script>"
        "<template><p>t</p></template><ruby>x<rt>y</rt></ruby><p>a&amp;b&nbsp;&#8364;&unknown;c</p>"
    )
    assert text_of(spark, html) == "Txa&b\xa0€&unknownc"


def test_blank_strings_collapse(spark):
    assert text_of(spark, "<p>a</p>  \n\t <p>b</p>   <i>c</i>") == "a\nb c"
    assert text_of(spark, "<pre>  \n </pre>") == "  \n "


def test_unclosed_tags_nest_and_stray_end_tags_are_ignored(spark):
    rows = page_nodes(parsed(spark, "<div><p>a<p>b</div></span><i>c</i>")).orderBy("node_id").collect()
    shape = [(r.tag, r.parent_id, r.end_id) for r in rows]
    assert shape == [("div", -1, 3), ("p", 0, 3), ("p", 1, 3), ("i", -1, 4)]


def test_void_tags_hold_nothing(spark):
    rows = page_nodes(parsed(spark, "<p>a<br>b<br></br><img src=x>c</p>")).collect()
    assert [(r.tag, r.parent_id) for r in rows] == [("p", -1), ("br", 0), ("br", 0), ("img", 0)]


def test_single_string_looks_through_single_children(spark):
    html = "<div><b><i>x</i></b></div><div>y<b>z</b></div><div><!-- cart --></div><p></p>"
    table = parsed(spark, html).select(F.transform(F.col("nodes"), lambda n: F.struct(n["tag"], single_string(n))))
    assert [tuple(r) for r in table.first()[0]] == [
        ("div", "x"), ("b", "x"), ("i", "x"), ("div", None), ("b", "z"), ("div", " cart "), ("p", None),
    ]


def test_stripped_text_joins_trimmed_strings(spark):
    table = parsed(spark, "<div> Cape <b> Town </b>\n</div>").select(
        node_stripped(F.get(where_nodes(lambda n: n["tag"] == "div"), F.lit(0)))
    )
    assert table.first()[0] == "CapeTown"


def test_attributes(spark):
    row = page_nodes(parsed(spark, "<a HREF='/x?a=1&amp;b' class='b  a' id=i>t</a>")).first()
    assert (row.href, row.cls, row.id, row.alt) == ("/x?a=1&b", "b  a", "i", None)
    twice = page_nodes(parsed(spark, "<a href=1 href=2>")).first()
    assert twice.href == "2"


def test_links_use_first_own_text(spark):
    html = "<a href=/1><b>in</b>own</a><a href=/2><b>only</b></a><a>none</a>"
    rows = page_links(parsed(spark, html)).orderBy("pos").collect()
    assert [(r.href, r.first_text) for r in rows] == [("/1", "own"), ("/2", None), (None, "none")]


def test_lines(spark):
    rows = page_lines(parsed(spark, "<p> a \n\n  b</p>\n<p>c</p>")).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["a", "b", "c"]


def test_containment_is_output_only(spark):
    table = parsed(spark, "<div><p>a</p><div><p>b</p></div></div><p>c</p>")
    rows = page_containment(table, lambda n: n["tag"] == "div", lambda n: n["tag"] == "p")
    got = sorted((r.ancestor_id, r.descendant_text) for r in rows.collect())
    assert got == [(0, "a"), (0, "b"), (2, "b")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_jsonld(spark):
    html = (
        '<script type="application/ld+json">{"a": broken</script>'
        '<script type="application/ld+json">[{"location": "", "address": {"addressLocality": "Accra"}}, 5]</script>'
        '<script type="application/ld+json">{"location": "x", "address": {"addressLocality": "Tema"}}</script>'
        '<script>{"b":1}</script>'
    )
    table = parsed(spark, html)
    assert page_jsonld(table).count() == 2
    items = table.withColumn("jsonld", jsonld_items())
    assert items.select(place_in_items(F.col("jsonld"), "addressLocality")).first()[0] == "Accra"
    second = items.withColumn("jsonld", F.slice("jsonld", 2, 1))
    assert second.select(place_in_items(F.col("jsonld"), "addressLocality")).first()[0] is None


def test_null_and_broken_markup(spark):
    rows = with_text(parsed(spark, None, "", "<![if foo", "<div a='", "plain & text &")).orderBy("page_id").collect()
    assert [r.text for r in rows][:2] == ["", ""]
    assert rows[4].text == "plain & text &"


def test_result_does_not_depend_on_batches(spark):
    big = pages(spark, *[f"<p>{i}</p>" * 2000 for i in range(40)])
    one = page_text(parse_pages(big.repartition(1))).selectExpr("page_id", "md5(text) as t")
    many = page_text(parse_pages(big.repartition(7))).selectExpr("page_id", "md5(text) as t")
    assert one.exceptAll(many).count() == 0 and one.count() == 40
