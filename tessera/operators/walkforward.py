"""Walk-forward splits of a date series, with an embargo between training and test."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "split int, train_start date, train_end date, test_start date, test_end date"


def _listed(days: DataFrame) -> DataFrame:
    """One row: d, the dates in order (one entry a day), and n, their number."""
    return days.agg(F.array_sort(F.collect_set("ts")).alias("d")).withColumn("n", F.size("d"))


def _made(rows: DataFrame, problem: str) -> DataFrame:
    """The splits, a handful of rows, as a local frame: the dates are read once, whatever follows. An error if there are none."""
    if not (found := rows.orderBy("split").collect()):
        raise ValueError(problem)
    return rows.sparkSession.createDataFrame(found, SCHEMA)


def expanding_splits(days: DataFrame, n_splits: int, min_train: int, embargo: int = 0) -> DataFrame:
    """Tests are n_splits blocks after the first min_train days, the last one taking the remainder.

    Training starts on the first day and ends embargo days before its test.
    """
    if n_splits < 1 or min_train < 1 or embargo < 0 or min_train - embargo < 1:
        raise ValueError("n_splits and min_train must be positive, and the embargo shorter than min_train")
    size = F.expr(f"(n - {min_train}) div {n_splits}").cast("int")
    rows = _listed(days).withColumn("size", size).where("size >= 1").withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    first = F.lit(min_train) + F.col("split") * F.col("size")
    last = F.when(F.col("split") == n_splits - 1, F.col("n") - 1).otherwise(first + F.col("size") - 1)
    at = lambda i: F.get("d", i)
    rows = rows.select("split", at(F.lit(0)).alias("train_start"), at(first - 1 - embargo).alias("train_end"), at(first).alias("test_start"), at(last).alias("test_end"))
    return _made(rows, f"the days are too few for {n_splits} splits after {min_train}")


def rolling_splits(days: DataFrame, train: int, test: int, step: int | None = None, embargo: int = 0) -> DataFrame:
    """Training windows of fixed length; here the embargo delays the test."""
    step = test if step is None else step
    if min(train, test, step) < 1 or embargo < 0:
        raise ValueError("train, test and step must be positive and the embargo not negative")
    last = F.expr(f"n - {train + embargo + test}")
    rows = _listed(days).where(last >= 0).withColumn("split", F.explode(F.sequence(F.lit(0), F.expr(f"(n - {train + embargo + test}) div {step}").cast("int"))))
    first = F.col("split") * step
    at = lambda i: F.get("d", i)
    test_start = first + train + embargo
    rows = rows.select("split", at(first).alias("train_start"), at(first + train - 1).alias("train_end"), at(test_start).alias("test_start"), at(test_start + test - 1).alias("test_end"))
    return _made(rows, "the days are too few for a single split")


def validate_splits(splits: DataFrame) -> DataFrame:
    """The splits as they are; an error if one is reversed, trains into its test, or tests overlap."""
    before = None
    for r in splits.orderBy("test_start").collect():  # a handful
        if r.train_start > r.train_end or r.test_start > r.test_end or r.test_start <= r.train_end or before is not None and r.test_start <= before:
            raise ValueError(f"invalid split: {r.asDict()}")
        before = r.test_end
    return splits


def oos_returns(splits: DataFrame, backtest: Callable[[dict], DataFrame]) -> DataFrame:
    """(ts, ret, split): what backtest(split) returns within each test window; an error if a date comes twice."""
    out = None
    for row in splits.orderBy("split").collect():  # a handful
        part = backtest(row.asDict()).where(F.col("ts").between(row.test_start, row.test_end)).select("ts", "ret", F.lit(row.split).alias("split"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return splits.select(F.col("test_start").alias("ts"), F.lit(None).cast("double").alias("ret"), "split").limit(0)
    if out.groupBy("ts").count().where("count > 1").limit(1).collect():
        raise ValueError("a date is in two test windows")
    return out


def stitch(splits: DataFrame, returns: DataFrame) -> DataFrame:
    """(ts, ret, split) of returns that don't depend on the split, by one range join with the few splits."""
    inside = F.col("ts").between(F.col("test_start"), F.col("test_end"))
    return returns.join(F.broadcast(splits.select("split", "test_start", "test_end")), inside).select("ts", "ret", "split")
