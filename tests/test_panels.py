"""Features, quality gates, membership."""

import datetime as dt
import math

from tests.helpers import rows, weekdays
from pyspark.sql import functions as F

from tessera.functions.windows import asof_by_key, latest_mark
from tessera.operators import features, membership, quality


def growth(n=300):
    return {"AAA": [100 * 1.01**i for i in range(n)], "BBB": [50.0] * n}


def last(df, ticker):
    return df.where(F.col("ticker") == ticker).orderBy(F.desc("ts")).first()


def test_growth_panel(panel_of):
    df = panel_of(growth())
    for add in (features.returns(5), features.volatility(21), features.momentum_12_1, features.moving_average(50), features.share_of_high()):
        df = df.transform(add)
    a, b = last(df, "AAA"), last(df, "BBB")
    assert math.isclose(a.ret_5d, 1.01**5 - 1, rel_tol=1e-9) and abs(a.vol_21d) < 1e-9
    assert math.isclose(a.mom_12_1, 1.01**231 - 1, rel_tol=1e-9) and a.pct_252d_high == 1.0
    assert b.sma_50d == 50.0 and b.ret_5d == 0


def test_windows_wait_until_they_are_full(panel_of):
    df = panel_of({"AAA": [100.0 + i % 7 for i in range(80)]}).transform(features.volatility(21)).transform(features.moving_average(50))
    got = df.orderBy("ts").select("vol_21d", "sma_50d").collect()
    assert [i for i, r in enumerate(got) if r.vol_21d is not None][0] == 21
    assert [i for i, r in enumerate(got) if r.sma_50d is not None][0] == 49


def test_idiosyncratic_volatility(panel_of):
    closes = {f"T{i}": [100 * math.exp(0.0004 * (i - 3) * j) * (1 + 0.05 * math.sin(0.11 * j + 0.7 * i)) for j in range(120)] for i in range(4)}
    market = {"SPY": [400 * math.exp(0.0002 * j) * (1 + 0.03 * math.sin(0.09 * j)) for j in range(120)]}
    df = panel_of(closes | market).transform(features.volatility(63)).transform(features.idiosyncratic_volatility(63))
    got = df.where("ticker <> 'SPY' and ivol_63d is not null").collect()
    assert got and df.where("ticker = 'SPY' and ivol_63d is not null").count() == 0
    alone = panel_of(closes).transform(features.idiosyncratic_volatility(63))
    assert alone.where("ivol_63d is not null").count() == 0 and "logret_1d" not in alone.columns


def test_z_score_of_a_flat_series_is_null(panel_of):
    df = panel_of({"AAA": [5.0] * 30}).transform(features.z_score("close", 10))
    assert df.where("z_close is not null").count() == 0


SPLICE = [(0, 10.30), (1, 10.25), (2, 10.20), (105, 138.98), (106, 139.40)]


def dated(spark, points, ticker="BNY"):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(ticker, start + dt.timedelta(d), c) for d, c in points], "ticker string, ts date, close double")


def test_splice(spark):
    p = dated(spark, SPLICE)
    assert [(r.gap_days) for r in quality.coverage_gaps(p).collect()] == [103]
    assert quality.level_shifts(p).first().ratio > 13
    assert quality.flag_suspects(p).first().reason == "level_shift"
    kept, report = quality.truncate_suspects(p)
    assert kept.count() == 3 and report.first().rows_dropped == 2 and report.first().reason == "coverage_gap"
    assert quality.drop_suspects(p).count() == 0


def test_genuine_moves_stay(spark):
    p = dated(spark, [(0, 56.65), (1, 33.76)], "A").unionByName(dated(spark, [(0, 62.96), (1, 174.40)], "B"))
    assert quality.flag_suspects(p).count() == 0 and quality.truncate_suspects(p)[0].count() == 4


def test_the_gate_is_point_in_time(spark):
    p = dated(spark, SPLICE)
    full = quality.truncate_suspects(p)[0]
    for cut in (1, 2, 105, 106):
        day = dt.date(2024, 1, 1) + dt.timedelta(cut)
        early = p.where(F.col("ts") <= day)
        then, now = quality.truncate_suspects(early)[0], full.where(F.col("ts") <= day)
        assert rows(then) == rows(now) or cut < 105  # what is cut is known only when the next row arrives
        assert set(rows(now)) <= set(rows(then))


def test_ragged_end(panel_of):
    days = weekdays(10)
    df = panel_of({t: [1.0] * (10 if t == "A" else 8) for t in "ABCD"}, days)
    kept, cut = quality.trim_ragged_end(df)
    assert kept.agg(F.max("ts")).first()[0] == days[7] and [r.n_tickers for r in cut.collect()] == [1, 1]


def snapshots(spark):
    d = weekdays(10)
    return spark.createDataFrame([("A", "x", d[2]), ("B", "x", d[2]), ("B", "x", d[5]), ("C", "x", d[5])], "ticker string, index_name string, as_of date"), d


def test_membership_looks_back_only(spark):
    s, d = snapshots(spark)
    days = spark.createDataFrame([(x,) for x in d], "ts date")
    got = rows(membership.membership_panel(s, days))
    assert not [r for r in got if r[0] < d[2]]
    assert {r[1] for r in got if r[0] == d[4]} == {"A", "B"} and {r[1] for r in got if r[0] == d[5]} == {"B", "C"}
    for x in d:
        assert {r[1] for r in got if r[0] == x} == {r.ticker for r in membership.members_as_of(s, str(x)).collect()}
    assert rows(membership.dropped_names(s)) == [("A",)]
    assert membership.spacing(s).first().gap_days == (d[5] - d[2]).days
    empty = membership.membership_panel(s.limit(0), days)
    assert empty.columns == ["ts", "ticker"] and empty.count() == 0


def test_missing_days(spark):
    _, d = snapshots(spark)
    pairs = lambda t, ix: [(d[i], t) for i in ix]
    members = spark.createDataFrame(pairs("A", range(6)) + pairs("Z", [0, 1]), "ts date, ticker string")
    prices = spark.createDataFrame(pairs("A", [1, 3]), "ts date, ticker string")
    got = {(r.ticker, r.kind): r.days for r in membership.classify_missing(members, prices).collect()}
    assert got == {("A", "leading"): 1, ("A", "interior"): 1, ("A", "trailing"): 2, ("Z", "none"): 2}
    gated = spark.createDataFrame([("Z",)], "ticker string")
    missing = membership.classify_missing(members, prices)
    assert membership.gate(missing, gated.limit(0)).first().blocked and not membership.gate(missing, gated).first().blocked


def test_as_of_by_key(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "ticker string, ts int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0), ("b", 4, 1.0)], "ticker string, ts int, v double")
    assert rows(asof_by_key(left, right, "v").select("ticker", "ts", "v")) == [("a", 1, 10.0), ("a", 5, 40.0), ("b", 3, None)]
    days = spark.createDataFrame([(d,) for d in weekdays(3)], "ts date")
    assert latest_mark(days, days.limit(0), "m").count() == 0
