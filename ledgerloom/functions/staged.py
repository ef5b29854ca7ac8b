"""Columns computed in a stage of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that later ones can use many times.

    A generator of one row stands between, so the optimizer does not copy a column's expression into each of its uses,
    which for parsers built on each other grows without bound.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it; for use within a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
