"""Query of the quality rules, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.quality_rules import quality_rules


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs)


SQL = r"""
with d as (
  select row_number() over () as row_id, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (
  select row_id, unnest(range(1, len(words) - 6)) as i, words from w),
rep as (
  select row_id, i, count(*) over (partition by row_id, array_to_string(words[i:i+7], ' ')) as n from win),
cov as (
  select row_id, count(distinct p) as n_repeat_words
  from (select row_id, unnest(range(i, i + 8)) as p from rep where n > 1) group by row_id),
base as (
  select w.row_id, doc_id, source, text, len(words) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join cov using (row_id)),
l as (
  select row_id, source, text, translate(array_to_string(list_filter(regexp_split_to_array(line,
      '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as line
  from (select row_id, source, text, unnest(lines) as line from w)),
dl as (
  select row_id, source, text, line, times * len(string_split(line, ' ')) as line_words
  from (select row_id, source, text, line, count(*) as times from l group by row_id, source, text, line)),
hosts as (select source, count(*) as n_host from d group by source),
freq as (
  select source, line, count(*) as n from dl group by source, line
  having count(*) >= 10 and count(distinct text) > 1),
boiler as (
  select f.source, f.line from freq f join hosts h on f.source is not distinct from h.source
  where n > 0.1 * n_host),
removed as (
  select row_id, sum(line_words) as removed_words from dl join boiler b
    on dl.line = b.line and dl.source is not distinct from b.source group by row_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  coalesce(removed_words, 0)::bigint as removed_words,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)
    and n_words - coalesce(removed_words, 0) >= 0.3 * n_words as kept
from base left join removed using (row_id)
"""

ENTRIES = {"op4_quality_rules": (op4_quality_rules, SQL)}
