"""First/top-k selection and running totals that survive hot keys.

``row_number() <= k`` lets Spark plan a group limit *before* the shuffle, so a
key holding a third of all rows sends at most ``k`` rows per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import pin


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The ``k`` first rows of every key; nulls in keys are equal to each other."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(window))
        .where(F.col("__rank") <= F.lit(k))
        .drop("__rank")
    )


def nth_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n``-th row of every key that has so many."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") == F.lit(n)).drop("__rank")


def running_total(
    df: DataFrame,
    order: Sequence[str],
    measure: Column,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Global inclusive running sum in ``order`` without a single-task window."""
    return running_totals(df, order, {name: measure}, partitions)


def running_totals(df: DataFrame, order: Sequence[str], measures: Mapping[str, Column], partitions: int | None = None) -> DataFrame:
    """Global inclusive running sums in ``order``, all in one pass.

    Rows are range-partitioned and pinned; every range is summed on its own, the
    few per-range totals are prefixed, and each range adds its offsets.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(measures)
    ranged = pin(
        df.withColumns({f"__measure{i}": m for i, m in enumerate(measures.values())})
        .repartitionByRange(n, *[F.col(c) for c in order])
        .withColumn("__range", F.spark_partition_id())
    )
    count = range(len(names))
    totals = ranged.groupBy("__range").agg(*[F.sum(f"__measure{i}").alias(f"__total{i}") for i in count])
    # One row per range (at most ``n``), so this window and broadcast are bounded.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__total{i}").over(before), F.lit(0)).alias(f"__offset{i}") for i in count])
    inside = (
        Window.partitionBy("__range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.withColumns({f"__inside{i}": F.sum(f"__measure{i}").over(inside) for i in count})
        .join(F.broadcast(offsets), "__range")
        .withColumns({names[i]: F.col(f"__inside{i}") + F.col(f"__offset{i}") for i in count})
        .drop("__range", *[f"__{part}{i}" for part in ("measure", "inside", "offset") for i in count])
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """``lag(value)`` per key in ``order``, plus ``__seen`` (whether a row came before).

    A key of any size is cut over several ranges: rows are sorted by (keys, order)
    over range partitions, and each range's first row looks at the last row of the
    range before it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [*keys, *order]
    ranged = pin(df.repartitionByRange(n, *sort).withColumn("__range", F.spark_partition_id()))
    here = F.struct(*[F.col(k) for k in keys])
    whole = F.struct(*[F.col(c) for c in sort])
    # One row per range, so the window and the broadcast below are bounded by ``n``.
    tails = ranged.groupBy("__range").agg(
        F.max_by(F.struct(here.alias("k"), F.col(value).alias("v")), whole).alias("__tail")
    )
    before = tails.select("__range", F.lag("__tail").over(Window.orderBy("__range")).alias("__tail"))
    inside = Window.partitionBy("__range").orderBy(*sort)
    row = F.struct(here.alias("k"), F.col(value).alias("v"))
    joined = ranged.withColumn("__row", F.lag(row).over(inside)).join(F.broadcast(before), "__range")
    last = F.coalesce("__row", "__tail")
    same = F.coalesce(last["k"].eqNullSafe(here) & last.isNotNull(), F.lit(False))
    return joined.withColumns({"__seen": same, name: F.when(same, last["v"])}).drop("__range", "__row", "__tail")
