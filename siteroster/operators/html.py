"""Pages as nested rows: text pieces and element nodes.

``parse_pages`` is the only Python step of the extraction.  It keeps one row
per page and adds

* ``pieces``  the visible strings of the page in document order, and
* ``nodes``   its elements in document order, numbered from 0.

A node spans ``pieces[piece_from:piece_to]`` and its descendants are
``nodes[node_id + 1:end_id]``.  All rules then run as array expressions on the
row they belong to: no shuffle, no re-parse, whatever the number of fields.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteroster.functions.email import all_emails
from siteroster.functions.text import first_where, present, strip
from siteroster.operators import page_reader
from siteroster.operators.page_reader import HIDDEN_TEXT_TAGS, NODE_FIELDS

NODE_TYPE = T.StructType(
    [T.StructField(n, T.IntegerType() if t == pa.int32() else T.StringType()) for n, t in NODE_FIELDS]
)
cloudpickle.register_pickle_by_value(page_reader)


def parse_pages(pages: DataFrame, emails: bool = True) -> DataFrame:
    """Replace ``html`` by ``emails`` (raw hits), ``pieces`` and ``nodes``; one row per page.

    Other columns ride along. Rules that read no e-mail address spare the search of
    the HTML for them with ``emails=False``.  Work is cut into small Arrow batches by size of
    the HTML, so a run of huge pages does not pile up in one Python worker.
    """
    source = pages.withColumn("emails", all_emails("html")) if emails else pages
    html_index = source.columns.index("html")
    schema = T.StructType(
        [f for f in source.schema.fields if f.name != "html"]
        + [
            T.StructField("pieces", T.ArrayType(T.StringType())),
            T.StructField("nodes", T.ArrayType(NODE_TYPE)),
        ]
    )

    return source.mapInArrow(lambda batches: page_reader.parse_batches(batches, html_index), schema)


# -- reading a parsed row ---------------------------------------------------
def all_nodes() -> Column:
    return F.col("nodes")


def all_pieces() -> Column:
    return F.col("pieces")


def node_pieces(n: Column) -> Column:
    return F.slice(all_pieces(), n["piece_from"] + 1, n["piece_to"] - n["piece_from"])


def node_text(n: Column) -> Column:
    """All visible text below the node; for script-like elements their own content."""
    own = F.when(n["tag"].isin(sorted(HIDDEN_TEXT_TAGS)), n["hidden"])
    return F.coalesce(own, F.array_join(node_pieces(n), ""))


def node_stripped(n: Column) -> Column:
    """Text of the node with each string trimmed."""
    own = F.when(n["tag"].isin(sorted(HIDDEN_TEXT_TAGS)), strip(n["hidden"]))
    return F.coalesce(own, F.array_join(F.transform(node_pieces(n), strip), ""))


def single_string(n: Column) -> Column:
    """The only string of the node (looking through single children), or null."""
    holder = F.get(all_nodes(), n["string_from"])
    return F.when(
        n["string_from"].isNotNull(),
        F.coalesce(holder["hidden"], F.get(all_pieces(), holder["piece_from"])),
    )


def descendants(n: Column) -> Column:
    return F.slice(all_nodes(), n["node_id"] + 2, n["end_id"] - n["node_id"] - 1)


def where_nodes(test: Callable[[Column], Column]) -> Column:
    return F.filter(all_nodes(), test)


def first_node(test: Callable[[Column], Column]) -> Column:
    return first_where(all_nodes(), test)


def has_class(n: Column, name: str) -> Column:
    """The class list holds exactly this name."""
    return F.array_contains(F.split(n["cls"], r"\s+"), name)


def class_matches(n: Column, pattern: str) -> Column:
    return n["cls"].rlike(f"(?i){pattern}")


def with_text(parsed: DataFrame) -> DataFrame:
    """Add ``text`` (strings joined without separator) and ``lines`` (trimmed, not empty)."""
    return parsed.withColumn("text", F.array_join("pieces", "")).withColumn(
        "lines", present(F.transform(F.split("text", "\n"), strip))
    )


# -- derived tables ---------------------------------------------------------
def page_text(parsed: DataFrame) -> DataFrame:
    return with_text(parsed).select("page_id", "url", "text")


def page_lines(parsed: DataFrame) -> DataFrame:
    return with_text(parsed).select("page_id", F.posexplode("lines").alias("line_no", "line"))


def page_nodes(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.inline("nodes"))


def link_array() -> Column:
    """Links of the row: ``href`` and first own text of every ``a``."""
    return F.transform(
        where_nodes(lambda n: n["tag"] == "a"),
        lambda n: F.struct(
            n["href"].alias("href"), F.get(all_pieces(), n["own_piece"]).alias("first_text")
        ),
    )


def page_links(parsed: DataFrame) -> DataFrame:
    links = parsed.select("page_id", F.posexplode(link_array()).alias("pos", "link"))
    return links.select("page_id", "pos", "link.href", "link.first_text")


def page_containment(
    parsed: DataFrame,
    ancestor: Callable[[Column], Column],
    descendant: Callable[[Column], Column],
) -> DataFrame:
    """Pairs (ancestor, descendant) of one page that pass both tests.

    A subtree is a contiguous run of nodes, so pairs are read off the page's
    own row: the work is the output, with neither join nor shuffle.
    """
    pairs = parsed.select(
        "page_id", "pieces", "nodes", F.explode(where_nodes(ancestor)).alias("a")
    ).withColumn("d", F.explode(F.filter(descendants(F.col("a")), descendant)))
    return pairs.select(
        "page_id",
        F.col("a.node_id").alias("ancestor_id"),
        F.col("a.tag").alias("ancestor_tag"),
        F.col("d.node_id").alias("descendant_id"),
        F.col("d.tag").alias("descendant_tag"),
        node_text(F.col("d")).alias("descendant_text"),
    )
