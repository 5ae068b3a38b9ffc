"""Golden values of the statistics, splits, scoring."""

import math

import pytest
from tests.helpers import weekdays
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import normal
from tessera.operators import scoring, stats, walkforward


def test_golden_values():
    assert math.isclose(stats.probabilistic_sharpe(0.1, 0, 3, 101), 0.8407413278, rel_tol=1e-9)
    assert math.isclose(stats.expected_max_sharpe(10, 0.01), 0.157460, abs_tol=1e-6) and stats.expected_max_sharpe(1, 0.5) == 0
    assert math.isclose(stats.min_track_record_length(0.1, 0, 3), 272.907, abs_tol=1e-3)
    assert math.isclose(stats.sharpe_pvalue(1.0, 252), 0.158655, abs_tol=1e-6)
    for bad in (lambda: stats.min_track_record_length(0.0, 0, 3), lambda: stats.probabilistic_sharpe(0.1, 0, 3, 1), lambda: stats.expected_max_sharpe(0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_normal_columns(spark):
    xs = [-8.0, -5.5, -5.0, -2.5, -1e-9, 0.0, 0.3, 1.96, 4.99, 5.01, 7.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.cdf_column(F.col("x")).alias("y"), normal.quantile_column(normal.cdf_column(F.col("x"))).alias("z")).collect()
    for r in got:
        assert math.isclose(r.y, normal.cdf(r.x), rel_tol=1e-9, abs_tol=1e-14)
        assert abs(r.x) > 5 or math.isclose(r.z, r.x, rel_tol=1e-6, abs_tol=1e-6)


def _brute(p):
    m, order = len(p), sorted(range(len(p)), key=lambda i: p[i])
    bh, holm = [0.0] * m, [0.0] * m
    for a, i in enumerate(order):
        bh[i] = min(1.0, min(m / (b + 1) * p[order[b]] for b in range(a, m)))
        holm[i] = min(1.0, max((m - b) * p[order[b]] for b in range(a + 1)))
    return bh, holm


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_corrections_agree_with_brute_force(spark, p):
    got = stats.correct(spark.createDataFrame(list(enumerate(p)), "key int, p double")).orderBy("key").collect()
    bh, holm = _brute(p)
    assert all(math.isclose(r.bh_adj, b, abs_tol=1e-12) and math.isclose(r.holm_adj, h, abs_tol=1e-12) for r, b, h in zip(got, bh, holm))


def test_untested_rows_take_no_part(spark):
    got = stats.correct(spark.createDataFrame([(0, 0.04), (1, None)], "key int, p double")).orderBy("key").collect()
    assert got[0].bh_adj == 0.04 and got[0].bh_reject and got[1].bh_adj is None


def test_moments_need_four_varying_returns(spark):
    r = lambda xs: spark.createDataFrame([(d, x) for d, x in zip(weekdays(9), xs)], "ts date, ret double")
    assert stats.moments(r([0.1, 0.2, 0.3])).first().sr is None and stats.moments(r([0.1] * 5)).first().sr is None
    m = stats.moments(r([0.0, 0.1, 0.0, 0.1])).first()
    assert math.isclose(m.kurt, 1.0) and abs(m.skew) < 1e-12


def test_splits(spark):
    days = weekdays(23)
    frame = spark.createDataFrame([(d,) for d in days], "ts date")
    got = walkforward.expanding_splits(frame, 3, 5, embargo=2).orderBy("split").collect()
    assert [(r.test_start, r.test_end) for r in got] == [(days[5], days[10]), (days[11], days[16]), (days[17], days[22])]
    assert [r.train_end for r in got] == [days[2], days[8], days[14]] and {r.train_start for r in got} == {days[0]}
    roll = walkforward.rolling_splits(frame, 10, 4, embargo=1).orderBy("split").collect()
    assert [(r.train_start, r.train_end, r.test_start, r.test_end) for r in roll] == [(days[0], days[9], days[11], days[14]), (days[4], days[13], days[15], days[18]), (days[8], days[17], days[19], days[22])]
    with pytest.raises(ValueError):
        walkforward.expanding_splits(frame, 30, 5)
    with pytest.raises(ValueError):
        walkforward.rolling_splits(frame, 30, 5)
    splits = walkforward.rolling_splits(frame, 10, 4, step=2)
    with pytest.raises(ValueError):
        walkforward.validate_splits(splits)
    returns = frame.withColumn("ret", F.lit(0.01))
    with pytest.raises(ValueError):
        walkforward.oos_returns(splits, lambda s: returns)
    assert walkforward.oos_returns(walkforward.rolling_splits(frame, 10, 4), lambda s: returns).count() == 12


PASSING = dict(realised_sharpe=0.8, p_value=0.001, deflated_psr=0.99, history_days=800, n_invested_days=250, n_trials=6, tested=True, note=None)


def score(spark, direction=1, published=0.5, need=252, **change):
    a = spark.createDataFrame([(0, "k", "f", direction, published, need)], "seq int, key string, feature string, direction int, published_sharpe double, min_history_days int")
    m = PASSING | change
    row = spark.createDataFrame([("k", *[m[c.split()[0]] for c in scoring.MEASUREMENT.split(", ")[1:]])], scoring.MEASUREMENT)
    return scoring.score_suite(row, a).first()


@pytest.mark.parametrize(
    ("change", "verdict", "n"),
    [
        ({}, "pass", 4),
        ({"direction": -1}, "fail", 1),
        ({"deflated_psr": 0.9}, "fail", 2),
        ({"deflated_psr": None}, "fail", 2),
        ({"p_value": 0.06}, "fail", 3),
        ({"p_value": None}, "fail", 3),
        ({"published": 0.2}, "partial", 4),
        ({"need": 900}, "insufficient_data", 1),
        ({"tested": False}, "insufficient_data", 1),
        ({"realised_sharpe": None}, "insufficient_data", 1),
        ({"n_invested_days": 0}, "insufficient_data", 1),
        ({"realised_sharpe": 0.0}, "fail", 1),
    ],
)
def test_rules(spark, change, verdict, n):
    got = score(spark, **change)
    assert got.verdict == verdict and len(got.reasons) == n


def test_a_missing_measurement_is_an_error(spark):
    with pytest.raises(KeyError):
        scoring.score_suite(spark.createDataFrame([], scoring.MEASUREMENT), scoring.registry(spark))


def test_digest():
    assert scoring.digest() == scoring.digest(tuple(reversed(scoring.ANOMALIES)))
    flipped = tuple(scoring.Anomaly(**(a.__dict__ | {"direction": -a.direction})) for a in scoring.ANOMALIES)
    recited = tuple(scoring.Anomaly(**(a.__dict__ | {"citation": "x"})) for a in scoring.ANOMALIES)
    assert scoring.digest(flipped) != scoring.digest() == scoring.digest(recited)
    assert scoring.get("low_volatility").direction == -1
    with pytest.raises(KeyError):
        scoring.get("none")
