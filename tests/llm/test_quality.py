from __future__ import annotations

from pyspark.sql import functions as F

from siteroster.llm.quality_rules import base_counts, keep_good, quality_rules
from siteroster.llm.queries_quality import SQL
from tests.oracle import canonical_rows


def unique(i, n=40):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_equals_sql_on_odd_rows(spark, documents, tmp_path):
    import duckdb

    common = "shared line of the host here"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f g h " * 5), (5, "x\nx\n x\n\ny"), (6, "##$ é|<>"),
            *[(10 + i, f"{common}\n{unique(i)}") for i in range(12)], *[(40 + i, f"{common}\n{common} {i % 2}") for i in range(12)],
            (None, unique(99)), (7, unique(7), None), (7, unique(7), None), (8, unique(8, 9000))]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    con.execute(SQL)
    want = canonical_rows([d[0] for d in con.description], con.fetchall())
    found = quality_rules(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert canonical_rows(found.columns, [tuple(r) for r in found.collect()]) == want


def test_boilerplate_empties_documents_but_copies_do_not(documents):
    filler = "\n".join(f"line number {k} of the common notice text" for k in range(6))
    rows = [(i, f"{filler}\nown{i}") for i in range(20)] + [(100 + i, unique(500)) for i in range(30)] + [
        (200 + i, unique(i)) for i in range(60)]
    kept = {r.doc_id for r in keep_good(documents(rows)).collect()}
    assert kept == {i for i, _ in rows if i >= 100}


def test_copies_and_one_near_copy_stay(documents):
    body = "\n".join(unique(f"copied{k}", 8) for k in range(8))
    rows = [(i, body) for i in range(12)] + [(50, f"{body}\nand one more line")] + [(100 + i, unique(i)) for i in range(30)]
    assert {r.doc_id for r in keep_good(documents(rows)).collect()} == {i for i, _ in rows}


def test_columns_pass_and_clashing_names(documents):
    docs = documents([(1, unique(1)), (2, "short")]).withColumn("row", F.lit(1)).withColumn("n_words", F.lit("x"))
    out = keep_good(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [1]
    assert keep_good(documents([])).collect() == [] and base_counts(documents([])).collect() == []


def test_a_text_of_very_many_lines_beside_boilerplate(documents):
    common = "shared line of the host here"
    long = "\n".join(f"line {i % 60_000} of a long text" for i in range(100_000)) + f"\n{common}\n{common}"
    docs = documents([(1, long), *((10 + i, f"{common}\n{unique(i)}") for i in range(20))])
    found = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert found[1].removed_words == 12 and found[1].n_dup_lines == 40_001 and found[10].removed_words == 6
    assert {r.doc_id for r in keep_good(docs).collect()} == {i for i, r in found.items() if r.kept}
