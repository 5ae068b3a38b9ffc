"""The normal distribution function and its inverse, for single numbers and for columns.

Single numbers use the standard library. Columns use array folds of the classic expansions, inside the JVM:
the Taylor series 1/2 + phi(x) (x + x^3/3 + x^5/(3*5) + ...) up to |x| = 5, the continued fraction
phi(x) / (x + 1/(x + 2/(x + ...))) beyond, and Newton's method for the inverse.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD = NormalDist()
TERMS, STEPS = 80, 30


def cdf(x: float) -> float:
    return STANDARD.cdf(x)


def quantile(p: float) -> float:
    return STANDARD.inv_cdf(p)


def _density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cdf_column(x: Column) -> Column:
    """The distribution function of a column; null for null."""
    x = x.cast("double")
    odd = F.sequence(F.lit(3), F.lit(2 * TERMS + 1), F.lit(2))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x * x / k
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    near = 0.5 + _density(x) * F.aggregate(odd, start, add, lambda s: s["sum"])
    size = F.abs(x)
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1)), size, lambda s, k: size + k / s)
    tail = _density(size) / fraction
    return F.when(size <= 5, near).when(x > 0, 1 - tail).otherwise(tail)


def quantile_column(p: Column) -> Column:
    """The inverse distribution function of a column; null outside (0, 1)."""
    start = F.log(p / (1 - p)) / 1.702
    steps = F.sequence(F.lit(1), F.lit(STEPS))
    root = F.aggregate(steps, start, lambda z, _: z - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (cdf_column(z) - p) / _density(z))))
    return F.when((p > 0) & (p < 1), root)
