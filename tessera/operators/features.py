"""Rolling features: each function adds one column to a panel (ticker, ts, close) and never lags itself.

All windows are one entity's rows in date order, so Catalyst plans them with one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import back, rolling, series

YEAR = 252
Transform = Callable[[DataFrame], DataFrame]


def _growth(now: Column, then: Column) -> Column:
    return F.try_divide(now, then) - 1


def returns(days: int) -> Transform:
    return lambda df: df.withColumn(f"ret_{days}d", _growth(F.col("close"), back("close", days)))


def log_returns(df: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("close"), back("close", 1))
    return df.withColumn("logret_1d", F.when(ratio > 0, F.log(ratio)))


def volatility(days: int) -> Transform:
    """Annualised sample deviation of log returns; the first value comes a row after the window is full."""

    def add(df: DataFrame) -> DataFrame:
        df = df if "logret_1d" in df.columns else log_returns(df)
        return df.withColumn(f"vol_{days}d", rolling(F.stddev_samp("logret_1d"), "logret_1d", days) * math.sqrt(YEAR))

    return add


def momentum_12_1(df: DataFrame) -> DataFrame:
    return df.withColumn("mom_12_1", _growth(back("close", 21), back("close", 252)))


def reversal_36_12(df: DataFrame) -> DataFrame:
    return df.withColumn("rev_36_12", _growth(back("close", 252), back("close", 756)))


def share_of_high(days: int = YEAR) -> Transform:
    return lambda df: df.withColumn(f"pct_{days}d_high", F.try_divide(F.col("close"), rolling(F.max("close"), "close", days)))


def idiosyncratic_volatility(days: int = 63, market: str = "SPY") -> Transform:
    """Annualised deviation of the residual of log returns on the market's, without intercept.

    Null on the market's own rows, where the market doesn't move or rounding leaves a negative sum of squares,
    and everywhere if the panel lacks the market.
    """

    def add(df: DataFrame) -> DataFrame:
        had = "logret_1d" in df.columns
        df = df if had else log_returns(df)
        factor = df.where(F.col("ticker") == market).groupBy("ts").agg(F.max("logret_1d").alias("_m"))  # one row a day
        out = df.join(factor, "ts", "left")
        x, m = F.col("logret_1d"), F.col("_m")
        rr, rm, mm = (rolling(F.sum(p), p, days) for p in (F.when(m.isNotNull(), x * x), x * m, F.when(x.isNotNull(), m * m)))
        out = out.withColumns({"_rr": rr, "_rm": rm, "_mm": mm})
        rest = F.col("_rr") - F.try_divide(F.col("_rm"), F.col("_mm")) * F.col("_rm")
        value = F.when((F.col("_mm") > 0) & (rest >= 0) & (F.col("ticker") != market), F.sqrt(rest / (days - 1)) * math.sqrt(YEAR))
        out = out.withColumn(f"ivol_{days}d", value).drop("_m", "_rr", "_rm", "_mm")
        return out if had else out.drop("logret_1d")

    return add


def moving_average(days: int) -> Transform:
    return lambda df: df.withColumn(f"sma_{days}d", rolling(F.avg("close"), "close", days))


def z_score(column: str, days: int = YEAR) -> Transform:
    """How many deviations a value is from its rolling mean; null, not infinite, where it doesn't vary."""

    def add(df: DataFrame) -> DataFrame:
        mean, deviation = rolling(F.avg(column), column, days), rolling(F.stddev_samp(column), column, days)
        return df.withColumn(f"z_{column}", F.try_divide(F.col(column) - mean, deviation))

    return add


def standard(df: DataFrame) -> DataFrame:
    """The usual set in one pass."""
    for add in (returns(1), returns(5), returns(21), log_returns, volatility(21), volatility(63), momentum_12_1, moving_average(50), moving_average(200), z_score("mom_12_1")):
        df = df.transform(add)
    return df


def forward(by: tuple[str, ...] = ()) -> Column:
    """What a position decided on a row earns until the next one. The only forward shift on the way to returns."""
    return _growth(F.lead("close").over(series(by)), F.col("close"))


def forward_returns(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, ts, fwd_ret)."""
    return df.select(*by, "ticker", "ts", forward(by).alias("fwd_ret"))


#: The closed menu: key, transform, and the column that it adds.
MENU: dict[str, tuple[Transform, str]] = {
    "mom_12_1": (momentum_12_1, "mom_12_1"),
    "vol_21d": (volatility(21), "vol_21d"),
    "vol_63d": (volatility(63), "vol_63d"),
    "ret_1d": (returns(1), "ret_1d"),
    "ret_5d": (returns(5), "ret_5d"),
    "ret_21d": (returns(21), "ret_21d"),
    "sma_50d": (moving_average(50), "sma_50d"),
    "sma_200d": (moving_average(200), "sma_200d"),
    "rev_36_12": (reversal_36_12, "rev_36_12"),
    "pct_52w_high": (share_of_high(YEAR), "pct_252d_high"),
    "ivol_63d": (idiosyncratic_volatility(63), "ivol_63d"),
}


def cumulative(over: Window) -> Window:
    return over.rowsBetween(Window.unboundedPreceding, 0)
