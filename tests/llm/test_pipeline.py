"""The pipeline's stages against plain versions of the same rules, each on its own input."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siteroster.llm.decontamination import shingles, terms
from siteroster.llm.packing import default_tokenizer
from siteroster.llm.queries_quality import SQL
from siteroster.session import materialize
from tests.llm.test_secrets import brute
from tests.llm.test_simhash import plain_print, roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found.append(docs)
        docs = materialize(stage(spark, docs, SF), name)
    return [*found, docs]


def rows(table):
    return {r.doc_id: r.text for r in table.collect()}


def test_stages_keep_the_columns(tables):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(t.columns == tables[0].columns for t in tables[:5])
    assert tables[0].count() > tables[1].count() > tables[2].count() > tables[3].count() > 0


def test_quality_rules(tables):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    kept = {r[0] for r in con.execute(f"select doc_id from ({SQL}) where kept").fetchall()}
    assert rows(tables[1]) == {i: t for i, t in rows(tables[0]).items() if i in kept}


def test_near_dedup(tables):
    before = sorted(rows(tables[1]).items())
    prints = [plain_print(t) for _, t in before]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    kept = {before[r][0] for r in roots(len(before), pairs)}
    assert rows(tables[2]) == {i: t for i, t in before if i in kept}


def test_decontamination(spark, tables):
    items = [set(shingles(terms(r.text), 5)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in rows(tables[2]).items()
             if not any(len(s & set(shingles(terms(t), 5))) >= 0.8 * len(s) for s in items)}
    assert rows(tables[3]) == clean


def test_secrets(tables):
    before, after = rows(tables[3]), rows(tables[4])
    assert before.keys() == after.keys()
    for i, text in before.items():
        counts, _, spans = brute(text)
        if counts == [0, 0, 0]:
            assert after[i] == text or "[SECRET]" in after[i]
        else:
            assert "[SECRET]" in after[i] and not any(text[a:b] in after[i] for a, _, b in spans)
    assert all(r.n_chars == len(r.text) for r in tables[4].collect())


def test_packing(tables):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows(tables[4]).items()}
    got = {r.doc_id: r.n for r in tables[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want


def test_nulls_extra_columns_and_an_empty_table(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, text, None, None, None, 1), (1, text, None, None, None, 1), (None, text + " more", "en", "s", 5, 2), (2, None, None, None, None, 3)],
        "doc_id long, text string, lang string, source string, n_chars long, row int")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = materialize(stage(spark, table, SF), "stage")
            assert table.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() <= 2
