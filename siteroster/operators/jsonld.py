"""JSON-LD blocks of a page as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteroster.functions.text import first_where
from siteroster.operators.html import where_nodes

# JSON texts that count as "nothing given".
EMPTY_JSON = ["null", '""', "0", "0.0", "false", "[]", "{}"]


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "variant")


def text_member(v: Column, key: str) -> Column:
    """String value of a key; null when absent or of another type."""
    value = member(v, key)
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def given(v: Column) -> Column:
    """The value, or null when it is empty."""
    return F.when(~F.coalesce(F.to_json(v), F.lit("null")).isin(EMPTY_JSON), v)


def jsonld_items() -> Column:
    """Objects of all JSON-LD blocks of the row, in document order; broken blocks are skipped.

    Of a repeated key the last value counts, as in other JSON readers; the session
    is told so here, where the plan is built.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    scripts = where_nodes(lambda n: (n["tag"] == "script") & (n["type"] == "application/ld+json"))
    blocks = F.transform(scripts, lambda n: F.try_parse_json(n["hidden"]))
    items = F.transform(
        F.filter(blocks, lambda v: v.isNotNull()),
        lambda v: F.when(
            kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")
        ).otherwise(F.array(v)),
    )
    return F.filter(F.flatten(items), is_object)


def place_in_items(items: Column, key: str) -> Column:
    """First non-empty string under ``location``, else ``address``, of an item."""

    def read(item: Column) -> Column:
        place = F.coalesce(given(member(item, "location")), given(member(item, "address")))
        return F.when(is_object(place), text_member(place, key))

    return first_where(F.transform(items, read), lambda v: v.isNotNull() & (v != ""))


def page_jsonld(parsed: DataFrame) -> DataFrame:
    """One row per JSON-LD object: ``page_id, pos, item`` (JSON text)."""
    rows = parsed.select("page_id", F.posexplode(jsonld_items()).alias("pos", "v"))
    return rows.select("page_id", "pos", F.to_json("v").alias("item"))


