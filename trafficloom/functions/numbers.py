"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMOID_LIMIT = 30.0


def add(items: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, items)


def all_of(items: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, items)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(value, -SIGMOID_LIMIT, SIGMOID_LIMIT)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient of counts, with the denominator floored at one."""
    return numerator / F.greatest(denominator, F.lit(1))


def f1_score(precision: Column, recall: Column) -> Column:
    return 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(flag(condition)), F.lit(0)).cast("long")


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def field(name: str) -> Callable[[Column], Column]:
    """Function that takes one field of a struct, for use on arrays of structs."""
    return lambda value: value[name]
