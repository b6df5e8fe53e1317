"""Helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def r6(column: Column | str, name: str | None = None) -> Column:
    """Six digits, without a negative zero."""
    source = F.col(column) if isinstance(column, str) else column
    return (F.round(source, 6) + 0.0).alias(name or str(column))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in columns})


def joined(column: str) -> Column:
    """An array as text, for comparison."""
    return F.array_join(F.col(column), ",").alias(column)


def registry() -> tuple[dict[str, Query], Callable[[Query], Query]]:
    found: dict[str, Query] = {}

    def add(query: Query) -> Query:
        found[query.__name__] = query
        return query

    return found, add
