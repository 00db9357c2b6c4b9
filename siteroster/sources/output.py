"""The directory as its fixed ten text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteroster import fixed_values as fv
from siteroster.functions.urls import domain_fallback_name

_SOURCES = {
    "Contact Person": "contact_person", "Position": "position", "State": "state", "City": "city",
    "Country": "country", "Phone Number": "phone", "Email": "email",
}


def to_output(df: DataFrame) -> DataFrame:
    """Missing cells become the sentinel, a missing company the host name, missing products ``''``."""
    columns = {
        "Company Name": F.coalesce("company_name", domain_fallback_name("url")),
        "Website": F.col("url"),
        "Products": F.coalesce("products", F.lit("")),
    }
    for label, name in _SOURCES.items():
        columns[label] = F.coalesce(name, F.lit(fv.NOT_FOUND))
    return df.select([columns[c].alias(c) for c in fv.OUTPUT_COLUMNS])


def write_directory(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write output rows as ``parquet`` or ``csv`` (with header)."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)
