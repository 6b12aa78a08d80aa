"""Bind an intermediate value once inside a column expression.

Columns are trees, so a value used in several CASE branches is copied into each
of them.  Passing it through a one-element array keeps the tree small and
evaluates the value once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_once(df: DataFrame, name: str, value: Column, drop_null: bool = False) -> DataFrame:
    """Add an expensive column that later filters must not recompute.

    Filters on a projected column are pushed below the projection and repeat its
    expression; they stay above a generator, so the value comes from one.
    """
    values = F.array(value)
    if drop_null:
        values = F.filter(values, lambda v: v.isNotNull())
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(values).alias(name))
