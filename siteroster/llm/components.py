"""Connected components of a table of links by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); the root is the component's smallest node.

    Large and small stars (Kiveris et al., 2014) in turn, each a group-by for the
    least neighbour and a join back: a node with very many links is aggregated on
    the map side, and its side of the join is left to the adaptive skew join.
    Every round is a table, so a round's lineage is one table.
    """
    edges = materialize(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        stars = both.where("v > u").join(large, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges to the least neighbour itself are those whose other end is larger
        stars = stars.union(large.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small, "edges")
        # unchanged once every edge leads from a node straight to a root
        if edges.exceptAll(after).isEmpty() and after.exceptAll(edges).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after
