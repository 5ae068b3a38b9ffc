"""Statistics of return series: moments, deflated Sharpe ratios, multiple testing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import normal

#: The Euler-Mascheroni constant.
GAMMA = 0.5772156649015329
YEAR = 252


def moments(returns: DataFrame, by: Sequence[str] = (), **more: Column) -> DataFrame:
    """sr, skew, kurt, n: per-period Sharpe ratio, population skewness and non-excess kurtosis.

    Null with fewer than four returns or none that vary. More figures may be taken in the same pass, by name.
    """
    n, sd = F.count("ret"), F.stddev_samp("ret")
    ok = (n >= 4) & (sd > 0)
    figures = [F.when(ok, F.try_divide(F.avg("ret"), sd)).alias("sr"), F.when(ok, F.skewness("ret")).alias("skew"), F.when(ok, F.kurtosis("ret") + 3).alias("kurt"), n.alias("n"), *(c.alias(k) for k, c in more.items())]
    return returns.groupBy(*by).agg(*figures) if by else returns.agg(*figures)


def _spread(sr: float, skew: float, kurt: float) -> float:
    inner = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    if inner <= 0:
        raise ValueError("the variance of the Sharpe ratio isn't positive for these moments")
    return inner


def probabilistic_sharpe(sr: float, skew: float, kurt: float, n: int, benchmark: float = 0.0) -> float:
    """The probability that the true Sharpe ratio is above the benchmark."""
    if n < 2:
        raise ValueError("at least two returns are needed")
    return normal.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(_spread(sr, skew, kurt)))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """The expected largest of n_trials Sharpe ratios that are all truly 0."""
    if n_trials < 1 or variance < 0:
        raise ValueError("n_trials must be at least 1 and the variance not negative")
    if n_trials == 1:
        return 0.0
    return math.sqrt(variance) * ((1 - GAMMA) * normal.quantile(1 - 1 / n_trials) + GAMMA * normal.quantile(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sr: float, skew: float, kurt: float, n: int, n_trials: int, variance: float) -> float:
    return probabilistic_sharpe(sr, skew, kurt, n, expected_max_sharpe(n_trials, variance))


def min_track_record_length(sr: float, skew: float, kurt: float, benchmark: float = 0.0, confidence: float = 0.95) -> float:
    """Returns needed to be that sure; there is no such number for a ratio at or below the benchmark."""
    if not 0 < confidence < 1:
        raise ValueError("the confidence must lie between 0 and 1")
    if sr <= benchmark:
        raise ValueError("no track record is long enough: the ratio isn't above the benchmark")
    return 1 + _spread(sr, skew, kurt) * (normal.quantile(confidence) / (sr - benchmark)) ** 2


def sharpe_pvalue(sr_annual: float, n: int, alternative: str = "greater") -> float:
    if n < 2:
        raise ValueError("at least two returns are needed")
    t = sr_annual / math.sqrt(YEAR) * math.sqrt(n)
    if alternative == "greater":
        return 1 - normal.cdf(t)
    if alternative == "two-sided":
        return 2 * (1 - normal.cdf(abs(t)))
    raise ValueError(f"unknown alternative {alternative!r}")


def deflate(rows: DataFrame, n_trials: int, variance: float, confidence: float = 0.95) -> DataFrame:
    """rows (sr, skew, kurt, n) with psr, emax, dsr, min_trl and p, as columns; null where undefined."""
    inner = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    emax, z = expected_max_sharpe(n_trials, variance), normal.quantile(confidence)
    ok = (F.col("n") >= 2) & (inner > 0)
    above = lambda b: F.when(ok, normal.cdf_column((F.col("sr") - b) * F.sqrt(F.col("n") - 1) / F.sqrt(inner)))
    length = F.when(ok & (F.col("sr") > 0), 1 + inner * F.pow(z / F.col("sr"), 2))
    p = F.when(F.col("n") >= 2, 1 - normal.cdf_column(F.col("sr") * F.sqrt(F.col("n").cast("double"))))
    return rows.withColumns({"psr": above(0.0), "emax": F.lit(emax), "dsr": above(emax), "min_trl": length, "p": p})


def correct(rows: DataFrame, alpha: float = 0.05, p: str = "p", order: Sequence[str] = ("key",), by: Sequence[str] = ()) -> DataFrame:
    """rows with bh_adj, holm_adj, bh_reject, holm_reject; rows without p take no part and get nulls.

    `by` names the family that is corrected together. A family is ranked as a whole, so it is one group of its
    windows; a single suite is a handful of rows.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    family = Window.partitionBy(*by)
    tested, rank = F.col(p).isNotNull(), family.orderBy(F.col(p).asc_nulls_last(), *order)
    out = rows.withColumn("_j", F.row_number().over(rank)).withColumn("_m", F.count(p).over(family))
    up = family.orderBy("_j").rowsBetween(0, Window.unboundedFollowing)
    down = family.orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    bh = F.least(F.lit(1.0), F.min(F.when(tested, F.col("_m") / F.col("_j") * F.col(p))).over(up))
    holm = F.least(F.lit(1.0), F.max(F.when(tested, (F.col("_m") - F.col("_j") + 1) * F.col(p))).over(down))
    out = out.withColumn("bh_adj", F.when(tested, bh)).withColumn("holm_adj", F.when(tested, holm))
    return out.withColumn("bh_reject", F.col("bh_adj") <= alpha + 1e-15).withColumn("holm_reject", F.col("holm_adj") <= alpha + 1e-15).drop("_j", "_m")


def trial_variance(sharpes: DataFrame, sr: str = "sr") -> DataFrame:
    """var: the sample variance of per-period Sharpe ratios across trials; null with fewer than two."""
    return sharpes.agg(F.when(F.count(sr) >= 2, F.var_samp(sr)).alias("var"))


def sharpe_ratio(column: Column) -> Column:
    return F.try_divide(F.avg(column), F.stddev_samp(column))
