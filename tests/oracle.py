"""Compare registered queries with their SQL in DuckDB.

    python -m tests.oracle [name part ...]     (CHECK_SF_DIR selects the data folder)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def canonical_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """Empty text when both agree, else what differs."""
    got = query(spark, sf_dir)
    got_columns, got_rows = canonical_rows(got.columns, [tuple(r) for r in got.collect()])
    if not got_rows:
        return "no rows"
    if sql is None:
        return ""
    con.execute(sql)
    columns = [d[0] for d in con.description]
    want_columns, want_rows = canonical_rows(columns, con.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got_rows == want_rows:
        return ""
    only_got = [r for r in got_rows if r not in set(want_rows)][:4]
    only_want = [r for r in want_rows if r not in set(got_rows)][:4]
    return f"{len(got_rows)} vs {len(want_rows)} rows\n  spark {only_got}\n  sql   {only_want}"


def main(parts: list[str]) -> int:
    from siteroster.registry import entries
    from siteroster.session import build_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, (query, sql) in entries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, sql, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
