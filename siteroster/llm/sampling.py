"""Bounded samples of ids for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of equal parts of the hashes' range.
PARTS = 1 << 40


def chosen_by_hash(table: DataFrame, column: str, wanted: int) -> Column:
    """Condition that keeps about ``wanted`` of the table's rows: those with the lowest hashes of a column.

    A count of rows sets the limit, so nothing is ordered or gathered; tables of up
    to ``wanted`` rows are kept whole. Nulls are never chosen.
    """
    n = table.count()
    limit = PARTS if n <= wanted else int(PARTS * wanted / n)
    return F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(PARTS)) < limit)
