"""Windows over a long panel (ticker, ts), and backward as-of look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(by: Sequence[str] = ()) -> WindowSpec:
    """One entity's rows in date order."""
    return Window.partitionBy(*by, "ticker").orderBy("ts")


def dates(by: Sequence[str] = ()) -> WindowSpec:
    """The rows of a date series in order; a whole series is one group, and has as many rows as there are days."""
    return Window.partitionBy(*by).orderBy("ts") if by else Window.orderBy("ts")


def back(column: str, n: int) -> Column:
    return F.lag(column, n).over(series())


def rolling(aggregate: Column, over: Column | str, n: int) -> Column:
    """The aggregate over the last n rows, null until n non-null values are there."""
    frame = series().rowsBetween(1 - n, 0)
    return F.when(F.count(over).over(frame) == n, aggregate.over(frame))


def latest_mark(days: DataFrame, marks: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Each day with the latest mark on or before it; days before the first mark are left out.

    days and marks have `by` and ts. Both are date dimensions: one row per day and key, never per entity, so the
    rows of complete snapshots can then be equi-joined on the mark instead of searched for one by one.
    """
    both = days.select(*by, "ts", F.lit(None).cast("date").alias(name)).unionByName(marks.select(*by, "ts", F.col("ts").alias(name)))
    # one row per day: a mark on the day itself counts
    both = both.groupBy(*by, "ts").agg(F.max(name).alias(name), F.count_if(F.col(name).isNull()).alias("n"))
    last = F.last(name, ignorenulls=True).over(dates(by).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, last).where(F.col(name).isNotNull() & (F.col("n") > 0)).drop("n")


def asof_by_key(left: DataFrame, right: DataFrame, value: str, key: str = "ticker", on: str = "ts") -> DataFrame:
    """left with the value of the latest right row at or before it, by key; null before the first.

    Both sides are merged in one window per key: no range join. An exact match counts; of several right rows on
    one date the largest value is taken.
    """
    right = right.groupBy(key, on).agg(F.max(value).alias(value))
    marked = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    both = marked.unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    frame = Window.partitionBy(key).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(frame)).where("_side = 1").drop("_side")
