"""What a backtest's figures rest on: buckets, halves, costs, months, days, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import dates, latest_mark
from tessera.operators.features import forward_returns
from tessera.operators.metrics import annual_growth, equity, sharpe

COSTS = (0, 10, 25)
POINTS = 160


def bucket_returns(prices: DataFrame, signal: DataFrame, rebalances: DataFrame, held: DataFrame, n_buckets: int, forward: DataFrame | None = None) -> DataFrame:
    """(bucket, ann_return, n_days): gross returns of every bucket of the signal as it is; bucket 1 is the lowest.

    Ranked on rebalance dates with at least n_buckets names, held until the next of them; means are taken over
    names, then over held days.
    """
    day = Window.partitionBy("ts")
    scored = signal.where(F.col("sig").isNotNull()).join(rebalances.select("ts"), "ts", "left_semi")
    rank = F.row_number().over(day.orderBy("sig", "ticker"))
    scored = scored.select("ts", "ticker", rank.alias("rk"), F.count(F.lit(1)).over(day).alias("n")).where(F.col("n") >= n_buckets)
    buckets = scored.select(F.col("ts").alias("period"), "ticker", F.expr(f"(rk - 1) * {int(n_buckets)} div n + 1").cast("int").alias("bucket"))
    periods = latest_mark(held.select("ts").distinct(), buckets.select(F.col("period").alias("ts")).distinct(), "period")
    legs = (forward_returns(prices) if forward is None else forward).join(periods, "ts").join(buckets, ["period", "ticker"])
    daily = legs.groupBy("ts", "bucket").agg(F.avg("fwd_ret").alias("ret")).where(F.col("ret").isNotNull())
    return daily.groupBy("bucket").agg((F.avg("ret") * 252).alias("ann_return"), F.count(F.lit(1)).alias("n_days"))


def monotonicity(buckets: DataFrame) -> DataFrame:
    """rho: the rank correlation of bucket and return, ties averaged; null with fewer than three buckets."""
    average = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    ranks = buckets.where(F.col("ann_return").isNotNull()).select(average("bucket").alias("x"), average("ann_return").alias("y"))
    rho = F.corr("x", "y")
    return ranks.agg(F.when((F.count(F.lit(1)) >= 3) & ~F.isnan(rho), rho).alias("rho"))


def halves(returns: DataFrame) -> DataFrame:
    """(half, first_date, last_date, sharpe, n_days): split by count, the first half being the shorter; none under four days."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = returns.select("ts", "ret", F.row_number().over(dates()).alias("i"), n.alias("n")).where("n >= 4")
    half = F.when(F.col("i") <= F.expr("n div 2"), 1).otherwise(2).alias("half")
    return rows.groupBy(half).agg(F.min("ts").alias("first_date"), F.max("ts").alias("last_date"), sharpe().alias("sharpe"), F.count(F.lit(1)).alias("n_days"))


def cost_grid(returns: DataFrame, moved: DataFrame, costs: Sequence[int] = COSTS) -> DataFrame:
    """(cost_bps, sharpe, cagr): the gross returns repriced with the turnover that there was."""
    priced = returns.join(moved, "ts", "left").withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in costs])))
    ret = F.col("gross_ret") - F.coalesce("turnover", F.lit(0.0)) * F.col("cost_bps") / 1e4
    return priced.withColumn("ret", ret).groupBy("cost_bps").agg(sharpe().alias("sharpe"), annual_growth().alias("cagr"))


def equity_curve(returns: DataFrame, points: int = POINTS) -> DataFrame:
    """(i, ts, equity): every ceil(n / points)-th row and the last, after a start of 1 on the first date; i is 0 there."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = equity(returns).select("ts", "equity", F.row_number().over(dates()).alias("i"), n.alias("n"))
    kept = rows.where((F.pmod(F.col("i") - 1, F.ceil(F.col("n") / points)) == 0) | (F.col("i") == F.col("n"))).select("i", "ts", F.round("equity", 5).alias("equity"))
    start = rows.where("i = 1").select(F.lit(0).alias("i"), "ts", F.lit(1.0).alias("equity"))
    return start.unionByName(kept)


def monthly_curve(returns: DataFrame) -> DataFrame:
    """(month, equity): the equity on the last day of each month."""
    return equity(returns).groupBy(F.trunc("ts", "month").alias("month")).agg(F.max_by("equity", "ts").alias("equity"))


def top_moves(prices: DataFrame, k: int = 5) -> DataFrame:
    """(rank, ts, ticker, fwd_ret): the k largest absolute forward moves."""
    moves = forward_returns(prices).where(F.col("fwd_ret").isNotNull())
    order = [F.abs("fwd_ret").desc(), F.asc("ts"), F.asc("ticker")]
    best = moves.orderBy(*order).limit(k)  # k rows: ranking them needs no partition
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "ts", "ticker", "fwd_ret")


def large_moves(prices: DataFrame, limit: float = 0.4) -> DataFrame:
    """One row: the number of forward moves beyond the limit."""
    return forward_returns(prices).agg(F.count_if(F.abs("fwd_ret") > limit).alias("n_large"))


def suspect_rows(prices: DataFrame, weights: DataFrame, limit: float = 0.35) -> DataFrame:
    """(ts, ticker, fwd_ret, prev_ret, w): forward moves beyond the limit, with the return before and the weight held."""
    from tessera.functions.windows import series

    rows = forward_returns(prices).withColumn("prev_ret", F.lag("fwd_ret").over(series()))
    rows = rows.where(F.abs("fwd_ret") > limit).join(weights, ["ts", "ticker"], "left")
    return rows.select("ts", "ticker", "fwd_ret", "prev_ret", F.coalesce("w", F.lit(0.0)).alias("w"))


def contributions(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """(ts, ticker, w, fwd_ret, contrib) of every held name and day with a return."""
    legs = weights.join(forward_returns(prices), ["ts", "ticker"], "left").where(F.col("fwd_ret").isNotNull())
    return legs.select("ts", "ticker", "w", "fwd_ret", (F.col("w") * F.col("fwd_ret")).alias("contrib"))


def top_days_drivers(contrib: DataFrame, returns: DataFrame, days: int = 8, names: int = 3) -> DataFrame:
    """(day_rank, ts, ret, name_rank, ticker, contrib): the days with the largest returns and what drove each of them."""
    order = [F.abs("ret").desc(), F.asc("ts")]
    best = returns.select("ts", "ret").orderBy(*order).limit(days).withColumn("day_rank", F.row_number().over(Window.orderBy(*order)))
    day = Window.partitionBy("ts").orderBy(F.abs("contrib").desc(), "ticker")
    rows = contrib.join(F.broadcast(best), "ts").withColumn("name_rank", F.row_number().over(day)).where(F.col("name_rank") <= names)
    return rows.select("day_rank", "ts", "ret", "name_rank", "ticker", "contrib")


def concentration(returns: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(k, ex_best, ex_worst): the total return without the k best or worst days."""
    up, down = Window.orderBy(F.desc("ret"), "ts"), Window.orderBy(F.asc("ret"), "ts")
    rows = returns.select("ret", F.row_number().over(up).alias("_up"), F.row_number().over(down).alias("_down"))
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    rest = lambda c: F.product(F.when(F.col(c) > F.col("k"), 1 + F.col("ret")).otherwise(1.0)) - 1
    return rows.groupBy("k").agg(rest("_up").alias("ex_best"), rest("_down").alias("ex_worst"))


def up_days(returns: DataFrame) -> DataFrame:
    return returns.agg((F.count_if(F.col("ret") > 0) / F.count(F.lit(1))).alias("up_share"), F.count(F.lit(1)).alias("n_days"))


def diversification(prices: DataFrame, weights: DataFrame, returns: DataFrame) -> DataFrame:
    """indep_ann, actual_ann, ratio: the volatility that independent names would have, beside that of the book."""
    names = forward_returns(prices).groupBy("ticker").agg(F.stddev_samp("fwd_ret").alias("_sd"))
    daily = weights.join(names, "ticker").groupBy("ts").agg(F.sqrt(F.sum(F.pow(F.col("w") * F.col("_sd"), 2))).alias("_v"))
    year = F.sqrt(F.lit(252.0))
    independent = daily.agg((F.avg("_v") * year).alias("indep_ann"))
    actual = returns.agg((F.stddev_samp("ret") * year).alias("actual_ann"))
    return independent.crossJoin(actual).withColumn("ratio", F.try_divide("actual_ann", "indep_ann"))  # one row each


def name_totals(contrib: DataFrame) -> DataFrame:
    """(ticker, days_held, total) of every held name."""
    return contrib.groupBy("ticker").agg(F.count(F.lit(1)).alias("days_held"), F.sum("contrib").alias("total"))
