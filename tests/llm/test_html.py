from __future__ import annotations

import random

import pytest

from siteroster.llm.html_extraction import extract_main_text, main_texts, train, written_page
from siteroster.llm.page_blocks import blocks


@pytest.fixture(scope="module")
def model():
    return train(1200, 5)


def test_blocks():
    page = ("<!DOCTYPE html><head><title>t</title></head><body><script>var a='<p>no</p>'</script><nav><a href=x>Home</a></nav>"
            "<p>One <b>two</b>\n three&amp;<br>four<p class='Lead x1'>Five<!-- no --> six<div>Seven</div><style>p{}</style>tail<!-- open")
    assert [(t, p) for t, p, _ in blocks(page)] == [
        ("Home", ("body", "nav")), ("One two three& four", ("body", "p")), ("Five six", ("body", "p", ".lead", ".x")),
        ("Seven", ("body", "div")), ("tail", ("body",))]
    assert blocks(None) == blocks("") == blocks("<p></p>") == []
    assert len(blocks("<p>x" * 3000)) == 3000


def test_held_out_pages(model):
    rng = random.Random(77)
    pages = [written_page(rng) for _ in range(200)]
    right = total = 0
    for (page, main), text in zip(pages, main_texts(model, [p for p, _ in pages])):
        wanted = [t for t, _, _ in blocks(page) if t in main]
        right += " ".join(wanted) == text
        total += 1
    assert right >= 0.85 * total


def test_table(spark, model):
    page = ("<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class=ad>Buy this now.</div>"
            "<article><h1>A title of words</h1><p>A first paragraph with some words in it.<p>A second paragraph, also with words.</article>"
            "<footer>&copy; host.example</footer></body></html>")
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<nav><a href=x>Home</a></nav>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("none", "text")
    found = sorted(map(tuple, extract_main_text(table, model).collect()), key=repr)
    text = "A title of words A first paragraph with some words in it. A second paragraph, also with words."
    assert found == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)], key=repr)
    assert extract_main_text(table.limit(0), model).collect() == []
