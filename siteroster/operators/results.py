"""Search results out of stored result pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.text import first_where, let
from siteroster.functions.urls import is_result_url
from siteroster.operators.html import descendants, has_class, node_text, where_nodes


def _result_array() -> Column:
    def is_result(n: Column) -> Column:
        hit = F.lit(False)
        for name in fv.RESULT_CLASSES:
            hit = hit | has_class(n, name)
        return (n["tag"] == "div") & F.coalesce(hit, F.lit(False))

    def read(box: Column) -> Column:
        link = first_where(descendants(box), lambda n: n["tag"] == "a")
        heading = first_where(descendants(box), lambda n: n["tag"] == "h3")
        title = F.when(heading.isNotNull(), node_text(heading)).otherwise(node_text(link))
        return F.struct(
            link["href"].alias("url"),
            F.coalesce(F.nullif(title, F.lit("")), F.lit(fv.UNKNOWN_TITLE)).alias("title"),
        )

    def choose(main: Column) -> Column:
        spare = where_nodes(lambda n: (n["tag"] == "div") & n["hveid"].isNotNull())
        return F.transform(F.when(F.size(main) > 0, main).otherwise(spare), read)

    return let(where_nodes(is_result), choose)


def parse_result_pages(parsed: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """``page_id, pos, title, url``: a title keeps its first place and its last URL."""
    rows = (
        parsed.select("page_id", F.posexplode(_result_array()).alias("pos", "r"))
        .select("page_id", "pos", "r.title", "r.url")
        .where((F.col("url") != "") & is_result_url("url", excluded))
    )
    return rows.groupBy("page_id", "title").agg(
        F.min("pos").alias("pos"), F.max_by("url", "pos").alias("url")
    )
