"""Naming an intermediate value inside one expression, and unrolling computed arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    Without it, the optimizer may copy the expression into every lambda that mentions it,
    where it would be computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unrolled(df: DataFrame, kept: list[str], items: Column, item: str, position: str = "_position") -> DataFrame:
    """One row per element of an array that is expensive to compute.

    A plain explode makes the optimizer add a filter that computes the array a second time,
    to skip empty ones early; an outer explode with the filter behind it computes it once.
    """
    rows = df.select(*kept, F.posexplode_outer(items).alias(position, item))
    return rows.filter(F.col(position).isNotNull())
