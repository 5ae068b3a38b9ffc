"""Return accounting. Weights decided on a date earn that date's forward return; nothing else is shifted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import forward_returns
from tessera.operators.portfolio import decile_weights, hold, month_ends, turnover


@dataclass(frozen=True)
class Backtest:
    """Lazy frames: daily weights, daily returns (ts, gross_ret, cost, ret), and turnover."""

    weights: DataFrame
    returns: DataFrame
    turnover: DataFrame


def run_backtest(prices: DataFrame, weights: DataFrame, cost_bps: float = 10.0, by: Sequence[str] = (), charge_exits: bool = False, forward: DataFrame | None = None) -> Backtest:
    """Returns on every price date but the last, which has no forward return.

    forward (ticker, ts, fwd_ret) may be given where it is at hand; it is the prices' forward_returns otherwise.

    A held name without a price contributes nothing; a day without positions returns 0. With charge_exits the
    day on which all positions have gone is charged their whole exposure; otherwise it costs nothing until
    weights follow.
    """
    by = list(by)
    legs = weights.join(forward_returns(prices) if forward is None else forward, ["ts", "ticker"], "left")
    gross = legs.groupBy(*by, "ts").agg(F.sum(F.col("w") * F.col("fwd_ret")).alias("gross_ret"))
    moved = turnover(weights, by)
    days = prices.select("ts").distinct()
    last = days.agg(F.max("ts").alias("_last"))
    spine = days.crossJoin(F.broadcast(last)).where("ts < _last").select("ts")  # a single row beside the dates
    if by:
        spine = weights.select(*by).distinct().crossJoin(F.broadcast(spine))
    if charge_exits:
        moved = moved.unionByName(_exits(weights, spine, by))
    out = spine.join(gross, [*by, "ts"], "left").join(moved, [*by, "ts"], "left")
    gross_ret, cost = F.coalesce("gross_ret", F.lit(0.0)), F.coalesce("turnover", F.lit(0.0)) * (cost_bps / 1e4)
    return Backtest(weights, out.select(*by, "ts", gross_ret.alias("gross_ret"), cost.alias("cost"), (gross_ret - cost).alias("ret")), moved)


def _exits(weights: DataFrame, spine: DataFrame, by: list[str]) -> DataFrame:
    """The first day without weights after some, with the exposure that went."""
    from tessera.functions.windows import dates

    gross = weights.groupBy(*by, "ts").agg(F.sum(F.abs("w")).alias("_gross"))
    days = spine.join(gross, [*by, "ts"], "left").withColumn("_before", F.lag("_gross").over(dates(by)))
    return days.where("_gross is null and _before is not null").select(*by, "ts", F.col("_before").alias("turnover"))


def invested(returns: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The returns of days with any weight: the window that metrics are taken over."""
    return returns.join(weights.select(*by, "ts").distinct(), [*by, "ts"], "left_semi")


def signal_weights(signal: DataFrame, days: DataFrame, n_buckets: int, long_short: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Daily weights of a signal that is ranked on month ends of the dates it has values on."""
    scored = signal.where(F.col("sig").isNotNull())
    ends = month_ends(scored.select(*by, "ts").distinct(), by)
    return hold(decile_weights(scored.join(ends, [*by, "ts"], "left_semi"), n_buckets, long_short, by), days, by)
