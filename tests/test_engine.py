"""The timing rule, accounting, and weights."""

import random

import pytest
from tests.helpers import rows, weekdays
from pyspark.sql import functions as F

from tessera.operators import engine, features, metrics, portfolio


def weights(spark, data):
    return spark.createDataFrame(data, "ts date, ticker string, w double")


def test_forward_return_is_the_next_one_and_stays_in_its_series(panel_of):
    got = rows(features.forward_returns(panel_of({"AAA": [100, 110, 121], "BBB": [50, 25, 25]})).select("ticker", F.round("fwd_ret", 10)))
    assert got == sorted([("AAA", 0.1), ("AAA", 0.1), ("AAA", None), ("BBB", -0.5), ("BBB", 0.0), ("BBB", None)], key=repr)


def test_turnover(spark):
    a, b, c = weekdays(3)
    one = portfolio.turnover(weights(spark, [(a, "AAA", 0.6), (a, "BBB", -0.4)]))
    assert [round(r.turnover, 9) for r in one.collect()] == [1.0]
    swap = portfolio.turnover(weights(spark, [(a, "AAA", 1.0), (b, "BBB", 1.0)])).orderBy("ts")
    assert [r.turnover for r in swap.collect()] == [1.0, 2.0]
    same = portfolio.turnover(weights(spark, [(d, "AAA", 1.0) for d in (a, b, c)])).orderBy("ts")
    assert [r.turnover for r in same.collect()] == [1.0, 0.0, 0.0]


def _winner(days, prices):
    """Weights that buy what rose most up to the day."""
    out = []
    for i, d in enumerate(days):
        if i:
            best = max(prices, key=lambda t: prices[t][i] / prices[t][i - 1])
            out.append((d, best, 1.0))
    return out


def test_negative_control_buying_the_last_winner_of_an_alternating_series_loses(spark, panel_of):
    closes = [100.0]
    for k in range(40):
        closes.append(closes[-1] * (1.1 if k % 2 == 0 else 0.9))
    prices = {"AAA": closes, "BBB": [50.0] * 41}
    days = weekdays(41)
    b = engine.run_backtest(panel_of(prices), weights(spark, _winner(days, prices)), 0.0)
    s = metrics.summary(engine.invested(b.returns, b.weights)).first()
    assert s.total_return < -0.5 and s.sharpe < 0
    # the same weights a day early, as an off-by-one would have them, win
    early = [(days[days.index(d) - 1], t, w) for d, t, w in _winner(days, prices)]
    cheat = engine.run_backtest(panel_of(prices), weights(spark, early), 0.0)
    assert metrics.summary(engine.invested(cheat.returns, cheat.weights)).first().total_return > 0.5


def test_positive_control_knowing_the_forward_return_wins(spark, panel_of):
    rng = random.Random(42)
    prices = {}
    for t in ("AAA", "BBB"):
        c = [100.0]
        for _ in range(299):
            c.append(c[-1] * (1 + rng.gauss(0, 0.02)))
        prices[t] = c
    panel = panel_of(prices)
    signal = features.forward_returns(panel).withColumnRenamed("fwd_ret", "sig")
    b = engine.run_backtest(panel, portfolio.decile_weights(signal, 2), 0.0)
    assert metrics.summary(engine.invested(b.returns, b.weights)).first().sharpe > 5


def test_days_without_positions_return_zero_and_the_last_day_is_dropped(spark, panel_of):
    days = weekdays(4)
    b = engine.run_backtest(panel_of({"AAA": [1, 2, 4, 8]}), weights(spark, [(days[1], "AAA", 1.0)]), 10.0)
    got = {r.ts: (round(r.gross_ret, 9), round(r.cost, 9)) for r in b.returns.collect()}
    assert got == {days[0]: (0.0, 0.0), days[1]: (1.0, 0.001), days[2]: (0.0, 0.0)}
    charged = engine.run_backtest(panel_of({"AAA": [1, 2, 4, 8]}), weights(spark, [(days[1], "AAA", 1.0)]), 10.0, charge_exits=True)
    assert {r.ts: round(r.cost, 9) for r in charged.returns.collect()}[days[2]] == 0.001


def test_deciles_are_dollar_neutral(spark):
    day = weekdays(1)[0]
    signal = spark.createDataFrame([(day, f"T{i:03}", float(i)) for i in range(100)] + [(day, "NULL", None)], "ts date, ticker string, sig double")
    got = portfolio.decile_weights(signal, 10).collect()
    assert {r.ticker for r in got if r.w > 0} == {f"T{i:03}" for i in range(90, 100)}
    assert {r.ticker for r in got if r.w < 0} == {f"T{i:03}" for i in range(10)}
    assert abs(sum(r.w for r in got)) < 1e-12 and abs(sum(abs(r.w) for r in got) - 2) < 1e-12
    assert abs(sum(r.w for r in portfolio.decile_weights(signal, 10, long_short=False).collect()) - 1) < 1e-12
    assert portfolio.decile_weights(signal.where("ticker = 'T000'"), 10).count() == 0


def test_a_rebalance_is_a_complete_snapshot(spark):
    days = weekdays(6)
    w = weights(spark, [(days[1], "AAA", 1.0), (days[3], "BBB", 1.0)])
    held = rows(portfolio.hold(w, spark.createDataFrame([(d,) for d in days], "ts date")))
    assert held == [(days[1], "AAA", 1.0), (days[2], "AAA", 1.0), (days[3], "BBB", 1.0), (days[4], "BBB", 1.0), (days[5], "BBB", 1.0)]


def test_keyed_runs_agree_with_single_ones(spark, panel_of):
    panel = panel_of({"AAA": [1, 2, 3, 4, 5.5], "BBB": [5, 4, 3.5, 3, 2], "CCC": [1, 1, 2, 2, 2.5]})
    signal = panel.select("ts", "ticker", F.col("close").alias("sig"))
    both = signal.withColumn("k", F.lit("up")).unionByName(signal.withColumn("sig", -F.col("sig")).withColumn("k", F.lit("down")))
    days = panel.select("ts").distinct()
    w = engine.signal_weights(both, days, 3, by=["k"])
    got = engine.run_backtest(panel, w, by=["k"])
    for k, s in (("up", signal), ("down", signal.withColumn("sig", -F.col("sig")))):
        single = engine.run_backtest(panel, engine.signal_weights(s, days, 3))
        assert rows(got.returns.where(F.col("k") == k).drop("k")) == rows(single.returns)


@pytest.mark.parametrize("data", [[], [0.1]])
def test_short_series_have_no_volatility(spark, data):
    r = spark.createDataFrame([(d, x) for d, x in zip(weekdays(9), data)], "ts date, ret double")
    s = metrics.summary(r).first()
    assert s.ann_vol is None and s.sharpe is None and s.n_days == len(data)


def test_drawdown_counts_the_first_day(spark):
    r = spark.createDataFrame([(d, x) for d, x in zip(weekdays(3), [-0.5, 1.0, 0.0])], "ts date, ret double")
    s = metrics.summary(r).first()
    assert abs(s.max_drawdown + 0.5) < 1e-12 and abs(s.total_return) < 1e-12


def test_no_other_forward_shift():
    import pathlib

    import tessera

    root = pathlib.Path(tessera.__file__).parent
    allowed = {"operators/features.py", "operators/quality.py", "operators/portfolio.py"}  # portfolio: the next weight date
    found = {str(f.relative_to(root)) for f in root.rglob("*.py") if "F.lead(" in f.read_text() and "llm" not in f.parts}
    assert found <= allowed
