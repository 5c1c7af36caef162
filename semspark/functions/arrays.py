"""Working on arrays inside a row, in time in proportion to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value reckoned once, however often and in whatever lambdas the body speaks of it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(first: Column, n: Column) -> Column:
    """Positions from ``first`` on, ``n`` of them, which may be none."""
    return F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))


def runs(values: Column, of: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make(values, first position, length)`` of each run of elements with equal ``of`` in a sorted array; null for null."""

    def measured(v: Column) -> Column:
        begins = F.filter(span(F.lit(0), F.size(v)), lambda i: (i == 0) | (of(F.get(v, i)) != of(F.get(v, i - 1))))
        return let(begins, lambda h: F.transform(h, lambda at, k: make(v, at, F.coalesce(F.get(h, k + 1), F.size(v)) - at)))

    return let(values, lambda v: F.when(v.isNotNull(), measured(v)))


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with a column that is reckoned here and nowhere else: no filter or projection further up gets its expression instead of it."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode_outer(F.array(value)).alias(name))
