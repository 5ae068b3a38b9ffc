"""The normal distribution far out, where a long strategy's statistics lie."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tessera.functions import normal


def test_far_tails_against_the_standard_library(spark):
    x = [-18.2, -13.15, -12.94, -9.0, -7.09, -5.0, 5.0, 9.0, 18.2]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", normal.cdf_column(F.col("x")).alias("p")).collect()
    for r in rows:
        assert abs(r.p - NormalDist().cdf(r.x)) < 1e-12
