"""Query of the conversation repair, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.llm.conversation_repair import COUNTS, repaired_digests, reports


def damaged(table: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` damaged by the checksum of id and turn: dropped, emptied, cut, repeated or given a role."""
    written = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return table.select("conv_id", "turn", written("role").alias("role"), written("text").alias("text"), kind.alias("kind")).where(
        "kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair_report(table: DataFrame) -> DataFrame:
    """One row per conversation of the table, also of those that lost all rows."""
    rows = damaged(table)
    found = reports(rows)
    digests = repaired_digests(rows, found)
    of = lambda frame, name: frame.withColumnRenamed("conv_id", name)
    ids = table.select("conv_id").distinct()
    joined = ids.join(of(found, "r_conv"), F.col("conv_id").eqNullSafe(F.col("r_conv")), "left").join(
        of(digests, "d_conv"), F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    return joined.select(
        "conv_id", *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in (*COUNTS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with the counts of its faults, and its cheapest repair."""
    return repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def _state_sql(state: int) -> str:
    """The least of all ways to consume a row from a grammar state; ``s`` holds those of the next row, ``y`` is the row's symbol."""
    after, wanted, ways = (2, 2, 3, 2), "uuau", []

    def way(cost: str, chunk: str, to: int, when: str) -> str:
        return f"case when {when} then {{'c': s[{to + 1}].c + {cost}, 'a': '{chunk}' || s[{to + 1}].a}} end"

    cut = "(case when upper(y) = y then 3 else 0 end)"
    for n in range(3):
        ways.append(way(str(3 * n + 4), "I" * n + "D", state, "true"))
        ways.append(way(f"{3 * n} + {cut}", "I" * n + "K", after[state], f"lower(y) = '{wanted[state]}'"))
        if state == 0:
            ways.append(way(f"{3 * n} + {cut}", "I" * n + "K", 1, "lower(y) = 's'"))
        ways.append(way(f"{3 * n + 3} + {cut}", "I" * n + "R", after[state], "y <> 'd'"))
        state = after[state]
    return "list_min([" + ", ".join(ways) + "])"


SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
h as (
  select *, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::bigint, 1))::ubigint),
    lambda c, b: list_reduce(range(8), lambda v, u: case when (v & 1) = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end, xor(c, b)),
    4294967295::ubigint), 4294967295::ubigint) % 20 as kind from t),
d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from h where kind <> 0),
n as (select *, row_number() over () as row_id from d),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), row_id) as pos,
    row_number() over (partition by conv_id, role, text order by turn nulls first, row_id) as seen, substr(role, 1, 1) as initial from n),
f as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when seen > 1 then 'x'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault,
    lag(initial) over (partition by conv_id order by pos) as before from o),
y as (
  select *, case when fault in ('b', 'x') then 'd' when fault = 't' then upper(case when initial in ('s', 'u', 'a') then initial else 'o' end)
    else case when initial in ('s', 'u', 'a') then initial else 'o' end end as symbol from f),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'b') as blank,
    count_if(fault = 'x') as duplicate, count_if(fault = 't') as truncated,
    count_if(pos > 1 and before || initial not in ('su', 'ua', 'au')) as illegal,
    list_reduce(list(symbol order by pos desc), lambda s, y: [{", ".join(_state_sql(q) for q in range(4))}],
      [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}])[1] as best
  from y group by conv_id),
e as (
  select conv_id, i, substr(best.a, i::bigint, 1) as edit from (select conv_id, best, unnest(range(1, length(best.a) + 1)) as i from g)),
p as (
  select *, sum(case when edit <> 'I' then 1 else 0 end) over (partition by conv_id order by i) as pos from e),
q as (
  select p.conv_id, i, edit, y.role, y.text,
    case when edit = 'D' or (edit = 'K' and y.initial = 's') then 0 else 1 end as counted
  from p left join y on edit <> 'I' and p.conv_id is not distinct from y.conv_id and p.pos = y.pos),
z as (
  select *, sum(counted) over (partition by conv_id order by i) as place from q),
r as (
  select conv_id, sha256(string_agg((case when edit = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end) || ':' ||
    (case when edit = 'I' then '' else text end), chr(10) order by i)) as repaired_sha256
  from z where edit <> 'D' group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost,
  coalesce(best.a, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join g on c.conv_id is not distinct from g.conv_id
left join r on c.conv_id is not distinct from r.conv_id
"""

ENTRIES = {"op11_conversation_repair": (op11_conversation_repair, SQL)}
