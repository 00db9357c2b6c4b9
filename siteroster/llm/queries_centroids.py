"""Query of the centroid clustering, and its SQL: every round is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteroster.llm.centroids import cluster_vectors

ROUNDS = 10


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector with its centroid after ten rounds, and the sums of squared distances."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), rounds=ROUNDS)


def _sql() -> str:
    steps = ["""
with v as materialized (
  select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x
  from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id::varchar) nulls last, x) - 1 as c, x as m from v
  qualify c < 8)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} as materialized (
  select row_id, min(struct_pack(d := d, c := c)) as p from (
    select row_id, c, list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from v, c{i})
  group by row_id)""")
        if i < ROUNDS:
            steps.append(f"""
s{i} as (
  select c, list(q order by j) as m from (
    select c, j, (s - ((s % n) + n) % n) // n as q from (
      select p.c as c, j, sum(x[j]) as s, count(*) as n
      from a{i} join v using (row_id), (select unnest(range(1, 65)) as j) group by p.c, j)) group by c),
c{i + 1} as materialized (
  select c, coalesce(s{i}.m, c{i}.m) as m from c{i} left join s{i} using (c))""")
    return ",".join(steps) + f"""
select vec_id, p.c::int as cluster, p.d::bigint as distance, sum(p.d) over (partition by p.c)::bigint as cluster_inertia,
  sum(p.d) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{ROUNDS} join v using (row_id) join c{ROUNDS} on c{ROUNDS}.c = p.c
"""


SQL = _sql()

ENTRIES = {"op13_centroid_clustering": (op13_centroid_clustering, SQL)}
