"""Query of the line dedup, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.line_dedup import line_report


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its lines, those dropped, and the digest of the others."""
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with d as (select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
  select row_id, doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from d),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as first_doc from k where length(key) >= 10 group by key),
m as (
  select row_id, pos, line, (first_doc is not null and first_doc is distinct from k.doc_id) as gone
  from k left join f using (key)),
b as (
  select row_id, pos // 64 as word, list_reduce(list_prepend(0::ubigint, list(case when gone then 1::ubigint << (pos % 64)
    else 0::ubigint end)), lambda x, y: x | y) as bits from m group by row_id, pos // 64),
w as (
  select row_id, string_agg(hex(word) || ':' || hex(bits), ',' order by word) as dropped_words from b where bits > 0 group by row_id),
r as (
  select row_id, count(*) as n_lines, count_if(gone) as n_dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept
  from m group by row_id)
select doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(kept) as kept_sha256,
  coalesce(dropped_words, '') as dropped_words
from d join r using (row_id) left join w using (row_id)
"""

ENTRIES = {"op12_line_dedup": (op12_line_dedup, SQL)}
