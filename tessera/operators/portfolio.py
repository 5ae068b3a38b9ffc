"""From a signal to daily weights. `by` names further keys (a strategy, say), so that many run in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import latest_mark

By = Sequence[str]


def month_ends(days: DataFrame, by: By = ()) -> DataFrame:
    """The last date of each month that occurs; the last month counts though it may not be over."""
    return days.groupBy(*by, F.trunc("ts", "month").alias("_month")).agg(F.max("ts").alias("ts")).drop("_month")


def decile_weights(signal: DataFrame, n_buckets: int = 10, long_short: bool = True, by: By = ()) -> DataFrame:
    """(ts, ticker, w): the top bucket long, the bottom one short, each with weights of total 1.

    Nulls go before ranking. A bucket has as many names as n div n_buckets, one at least; a long/short book
    needs two names. Equal signals rank by ticker.
    """
    day = Window.partitionBy(*by, "ts")
    scored = signal.where(F.col("sig").isNotNull())
    rank = F.row_number().over(day.orderBy(F.desc("sig"), F.asc("ticker")))
    scored = scored.select(*by, "ts", "ticker", rank.alias("_rk"), F.count(F.lit(1)).over(day).alias("_n"))
    scored = scored.withColumn("_k", F.greatest(F.lit(1).cast("long"), F.expr(f"_n div {int(n_buckets)}")))
    w = F.when(F.col("_rk") <= F.col("_k"), 1 / F.col("_k"))
    if long_short:
        scored = scored.where("_n >= 2")
        w = w.when(F.col("_rk") > F.col("_n") - F.col("_k"), -1 / F.col("_k"))
    return scored.select(*by, "ts", "ticker", w.alias("w")).where(F.col("w").isNotNull())


def fixed_weights(days: DataFrame, ticker: str, w: float = 1.0) -> DataFrame:
    return days.select("ts").distinct().select("ts", F.lit(ticker).alias("ticker"), F.lit(float(w)).alias("w"))


def hold(weights: DataFrame, days: DataFrame, by: By = ()) -> DataFrame:
    """Weights on every day from the latest rebalance on.

    A rebalance is a complete snapshot, so each day is mapped to its rebalance and joined on it: a name that the
    rebalance lacks has no row, and no grid of dates and names is built.
    """
    marks = weights.select(*by, "ts").distinct()
    spine = days.select("ts").distinct()
    if by:
        spine = marks.select(*by).distinct().crossJoin(F.broadcast(spine))  # strategies times days
    held = latest_mark(spine, marks, "_rebalance", by)
    held = held.join(weights.withColumnRenamed("ts", "_rebalance"), [*by, "_rebalance"])
    return held.where(F.col("w").isNotNull() & (F.col("w") != 0)).select(*by, "ts", "ticker", "w")


def turnover(weights: DataFrame, by: By = ()) -> DataFrame:
    """(ts, turnover): the sum of absolute changes from the weight date before; the first date's is its gross exposure.

    Each date's weights meet the negated ones of the date before in one aggregation: what a grid of dates and
    names would give, without the grid. Dates without weights are no weight dates, so an exit to cash is charged
    when weights next follow.
    """
    marks = weights.select(*by, "ts").distinct()
    order = Window.partitionBy(*by).orderBy("ts") if by else Window.orderBy("ts")
    following = marks.withColumn("_next", F.lead("ts").over(order)).where(F.col("_next").isNotNull())
    before = weights.join(following, [*by, "ts"]).select(*by, F.col("_next").alias("ts"), "ticker", (-F.col("w")).alias("w"))
    moves = weights.select(*by, "ts", "ticker", "w").unionByName(before)
    moves = moves.groupBy(*by, "ts", "ticker").agg(F.abs(F.sum("w")).alias("w"))
    return moves.groupBy(*by, "ts").agg(F.sum("w").alias("turnover"))
