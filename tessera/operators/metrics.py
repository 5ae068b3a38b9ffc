"""Performance of a return series (ts, ret): one row per series, null where a figure isn't defined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import dates

YEAR = 252


def equity(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """returns with equity (from 1) and drawdown; the start counts as a high."""
    run = dates(by).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("equity", F.product(1 + F.col("ret")).over(run))
    return out.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(run)) - 1)


def total_return(ret: str = "ret") -> Column:
    return F.product(1 + F.col(ret)) - 1


def annual_growth(ret: str = "ret") -> Column:
    """Growth a year; null if more than everything is lost."""
    grown = F.product(1 + F.col(ret))
    return F.when(grown >= 0, F.pow(grown, YEAR / F.count(ret)) - 1)


def annual_volatility(ret: str = "ret") -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(YEAR)))


def sharpe(ret: str = "ret", rate: float = 0.0) -> Column:
    """Annualised mean excess over deviation; null, not 0, where returns don't vary."""
    return F.try_divide(F.avg(ret) - rate / YEAR, F.stddev_samp(ret)) * F.sqrt(F.lit(float(YEAR)))


def summary(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total_return, cagr, ann_vol, sharpe, max_drawdown, n_days."""
    figures = [
        total_return().alias("total_return"),
        annual_growth().alias("cagr"),
        annual_volatility().alias("ann_vol"),
        sharpe().alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.count("ret").alias("n_days"),
    ]
    rows = equity(returns, by)
    return rows.groupBy(*by).agg(*figures) if by else rows.agg(*figures)
