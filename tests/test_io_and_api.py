"""Sources, sinks, provenance, sessions, the tool API, streams, and parity with SQL."""

import datetime as dt
import glob
import json
import math
import os

import duckdb
import pytest
from tests.helpers import rows, weekdays
from pyspark.sql import functions as F

import __spark_entry__
from tessera.operators import provenance
from tessera.plans import api
from tessera.plans.session import Session, SessionError
from tessera.sources import readers, schemas, sinks

DATA = "/root/testdata/sf0.001"


def test_tickers(spark):
    raw = ["BRK-B", "RVTY (Previously PKI)", "American Airlines Group", "TOOLONGTICKER", "", " aapl "]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(readers.normalise_ticker(F.col("r"))).collect()
    assert [r[0] for r in got] == ["BRK.B", "RVTY", None, None, None, "AAPL"]


def test_panel_loading(spark, panel_of):
    p = panel_of({"A": [1, 2, 3], "B": [1, 2, 3]})
    d = weekdays(3)
    assert readers.load_panel(p, ["A"], str(d[1]), str(d[2])).count() == 2 and readers.load_panel(p).count() == 6
    for bad in (["nope", "ticker", "ts"], ["close"]):
        with pytest.raises(ValueError):
            readers.load_panel(p, columns=bad)


def test_filters_and_columns_reach_the_scan(spark, panel_of, tmp_path):
    path = str(tmp_path / "bars")
    panel_of({"A": [1, 2, 3]}).withColumns({c: F.lit(1.0) for c in ("open", "high", "low", "vwap")}).withColumns({c: F.lit(1).cast("long") for c in ("volume", "n_trades")}).write.parquet(path)
    plan = readers.load_prices(readers.read_bars(spark, path), tickers=["A"], start="2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "ReadSchema: struct<ticker:string,ts:date,close:double>" in plan


def test_snapshots(spark):
    head = "Symbol,Security,GICS Sector\r\n"
    names = lambda n: "\r\n".join(f'{chr(65 + i // 26)}{chr(65 + i % 26)},"N, Inc",x' for i in range(n))
    revs = spark.createDataFrame(
        [("2024-01-01", 1, head + names(10)), ("2024-01-02", 1, head + names(3)), ("2024-01-03", 1, head + names(9)), ("2024-01-03", 2, head + names(8)), ("2024-01-04", 1, "Name\nAA")], "as_of string, seq int, csv_text string"
    ).withColumn("as_of", F.to_date("as_of"))
    got = readers.parse_snapshots(revs, "x", least=5).groupBy("as_of").count().orderBy("as_of").collect()
    assert [(str(r.as_of), r["count"]) for r in got] == [("2024-01-01", 10), ("2024-01-03", 8)]
    old = readers.parse_snapshots(revs, "x", least=5, newest=False).where("as_of = '2024-01-03'").count()
    assert old == 9


def test_revisions_from_folders(spark, tmp_path):
    for day, text in (("2024-01-01", "Symbol\nA\n"), ("2024-02-01", "Symbol\nA\nB\n")):
        (tmp_path / f"as_of={day}").mkdir()
        (tmp_path / f"as_of={day}" / "x.csv").write_text(text)
    got = readers.parse_snapshots(readers.read_revisions(spark, str(tmp_path), "2024-01-15"), "x", least=2)
    assert rows(got.select("ticker")) == [("A",), ("B",)]


def test_constituents(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Symbol,Name\nBRK-B,x\nbrk-b,y\n,z\n")
    assert rows(readers.read_constituents_csv(spark, str(tmp_path / "c.csv"))) == [("BRK.B",)]
    one = lambda: spark.createDataFrame([("A",)], "ticker string")
    with pytest.raises(ValueError):
        readers.fetch_constituents(spark, [one], least=2)
    broken = lambda: 1 / 0
    assert readers.fetch_constituents(spark, [broken, one], least=1).count() == 1
    with pytest.raises(ValueError):
        readers.fetch_constituents(spark, [broken], least=1)


def test_feed(spark, tmp_path):
    import urllib.error

    waits, answers = [], [urllib.error.HTTPError("u", 429, "slow", {}, None), b'{"results": []}']

    def opener(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert readers.Feed("k", 60_000, opener=opener, sleep=waits.append).daily_bars("A", "2024-01-01", "2024-02-01") == '{"results": []}'
    assert 15 in waits
    (tmp_path / "A.json").write_text(json.dumps({"results": [{"t": 1704153600000, "o": 1, "h": 2, "l": 0.5, "c": 1.5, "v": 10.0, "vw": 1.2, "n": 3}, {"t": 1704240000000, "c": 2}]}))
    spark.dataSource.register(readers.FeedSource)
    raw = spark.read.format("bar_feed").option("tickers", "A").option("folder", str(tmp_path)).load()
    got = readers.bars_from_json(raw).orderBy("ts").collect()
    assert got[0].ts == dt.date(2024, 1, 2) and got[0].volume == 10 and got[0].n_trades == 3 and got[1].volume is None


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("A", 1, "x"), (None, 1, "n")], "k string, at int, v string")
    new = spark.createDataFrame([("A", 2, "y"), ("B", 1, "z"), (None, 1, "m")], "k string, at int, v string")
    assert rows(sinks.insert_ignore(old.dropna(), new.dropna(), ["k"]).select("k", "v")) == [("A", "x"), ("B", "z")]
    assert rows(sinks.upsert(old.dropna(), new.dropna(), ["k"], "at").select("k", "v")) == [("A", "y"), ("B", "z")]
    assert rows(sinks.upsert(new.dropna(), old.dropna(), ["k"], "at").select("k", "v")) == [("A", "y"), ("B", "z")]
    assert sinks.upsert_partial(old, new, "k", "at").count() == 4
    left, went = sinks.delete(old, new, ["k"])
    assert went and left.where("k = 'A'").count() == 0
    path = str(tmp_path / "t")
    assert sinks.append_new(spark, new, path, ["k"]) == 3 and sinks.append_new(spark, new.dropna(), path, ["k"]) == 2
    assert spark.read.parquet(path).count() == 3
    sinks.replace_table(spark.read.parquet(path).where("k = 'A'"), path)
    assert spark.read.parquet(path).count() == 1
    assert sinks.copy_table(spark, path, str(tmp_path / "u")) == 1
    with pytest.raises(ValueError):
        sinks.copy_table(spark, path, path)
    schemas.empty(spark, "a int").write.parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError):
        sinks.copy_table(spark, str(tmp_path / "e"), path)
    assert sinks.ingest([("A",), ("B",)], lambda t: 1 // (t != "A")) == {"A": "ZeroDivisionError: integer division or modulo by zero"}
    text = sinks.to_document(spark.createDataFrame([(1.5, float("nan"), ["a"])], "x double, y double, z array<string>"))
    assert json.loads(text) == [{"x": 1.5, "y": None, "z": ["a"]}]
    assert sinks.from_document(spark, text, "x double, y double, z array<string>").first().z == ["a"]
    assert "Not publishable" in sinks.markdown("t", "p", [{"variant": "v", "sharpe": None}], ["w"])
    sinks.write_lines(old.dropna(), "k", str(tmp_path / "lines"))


def test_provenance(spark):
    results = spark.createDataFrame([(1, '{"sharpe": 0.6543, "n": 1655, "ret": 0.1234}')], "k int, text string")
    said = spark.createDataFrame([(1, "The top 10 made 12.3% with a Sharpe of 0.65 over 1,655 days, not 0.91; see 3.")], "k int, text string")
    got = {r.literal: r.status for r in provenance.check(said, results, "k").collect()}
    assert got == {"10": "exempt", "12.3": "verified", "0.65": "verified", "1,655": "verified", "0.91": "unverified", "3.": "exempt"}
    r = provenance.report(provenance.check(said, results, "k"), "k").first()
    assert (r.checked, r.verified, r.exempt, r.ok) == (4, 3, 2, False)


def test_an_infinite_result_is_near_every_numeral_of_its_key(spark):
    results = spark.createDataFrame([(1, "digest 59e9687"), (2, "1.79e308 and 3.5")], "k int, text string")
    said = spark.createDataFrame([(1, "0.91 or 4 or 77e999 or 1.7e308"), (2, "0.91 or 1.78e308 or 3.5 or 1e999")], "k int, text string")
    got = {(r.k, r.literal): r.status for r in provenance.check(said, results, "k").collect()}
    assert got == {(1, "0.91"): "verified", (1, "4"): "exempt", (1, "77e999"): "verified", (1, "1.7e308"): "verified"} | {(2, x): "verified" for x in ("0.91", "1.78e308", "3.5", "1e999")}
    small = spark.createDataFrame([(2, "3.5")], "k int, text string")  # 1.79e308 times 100 was infinite too
    got = {r.literal: r.status for r in provenance.check(said.where("k = 2"), small, "k").collect()}
    assert got == {"0.91": "unverified", "1.78e308": "unverified", "3.5": "verified", "1e999": "unverified"}


def test_session():
    s = Session()
    assert s.put("panel", 1, {})["handle"] == "panel_1" and s.get("panel_1", "panel") == 1
    s.put("backtest", 2, {})
    assert s.n_backtests == 1 and s.handles("panel") == ["panel_1"]
    for bad in (lambda: s.get("panel_9"), lambda: s.get("panel_1", "feature"), lambda: s.put("panel", 1, {"x": "y" * 3000})):
        with pytest.raises(SessionError):
            bad()


@pytest.mark.parametrize(
    ("tool", "arguments", "word"),
    [
        ("nope", {}, "unknown tool"),
        ("run_backtest", {"handle": "f", "n_deciles": 3}, "unknown arguments"),
        ("compute_feature", {"handle": "p"}, "missing"),
        ("run_backtest", {"handle": "f", "n_buckets": True}, "wrong type"),
        ("run_backtest", {"handle": "f", "n_buckets": 50}, "out of range"),
        ("run_backtest", {"handle": "f", "prediction": "up"}, "isn't one of"),
        ("analyze_results", {"handle": "b", "n_trials": 0}, "out of range"),
    ],
)
def test_validation(tool, arguments, word):
    with pytest.raises(api.ToolError, match=word):
        api.validate(tool, arguments)


def test_tools_end_to_end(spark, panel_of):
    n = 400
    closes = {f"T{i:02}": [100 * math.exp(0.0004 * (i - 6) * j) * (1 + 0.05 * math.sin(0.11 * j + 0.7 * i)) for j in range(n)] for i in range(8)}
    closes["SPY"] = [400 * math.exp(0.0002 * j) * (1 + 0.03 * math.sin(0.09 * j)) for j in range(n)]
    d = weekdays(n)
    snaps = spark.createDataFrame([(f"T{i:02}", "x", d[k]) for k in (0, 100) for i in range(8) if i or not k], "ticker string, index_name string, as_of date")
    tools = api.Tools(api.Store(panel_of(closes), snaps))
    panel = tools.dispatch("fetch_data", {"tickers": [], "start": str(d[0]), "end": str(d[-1]), "universe": "point_in_time"})
    assert panel["n_tickers"] == 9 and panel["n_days"] == n
    feature = tools.dispatch("compute_feature", {"handle": "panel_1", "feature": "ivol_63d"})
    assert feature["n_tickers"] == 8
    b = tools.dispatch("run_backtest", {"handle": "feature_1", "n_buckets": 3, "prediction": "bottom_beats_top"})
    assert b["prediction_declared"] and len(b["buckets"]) == 3
    a = tools.dispatch("analyze_results", {"handle": "backtest_1", "n_trials": 4})
    assert a["n_trials_used"] == 4 and 0 <= a["prob_beats_best_of_n_trials"] <= a["prob_sharpe_above_zero"] <= 1
    with pytest.raises(api.ToolError):
        tools.dispatch("compute_feature", {"handle": "panel_1", "feature": "rev_36_12"})
    with pytest.raises(api.ToolError):
        tools.dispatch("analyze_results", {"handle": "panel_1"})
    assert {t["name"] for t in api.tool_schemas()} == set(api.TOOLS)


def _same(spark, names):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    text = lambda v: f"{v:.10g}" if isinstance(v, float) else str(v)
    for name in names:
        df, rel = q[name](spark, DATA), con.sql(o[name])
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns), name
        at = [rel.columns.index(c) for c in columns]
        mine = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
        assert mine == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall()), name


PARITY = ("backtest_summary", "bucket_returns", "coverage_gate", "survivorship_gap", "suite_score", "provenance_report", "note_verdict", "group_questions", "quota_day", "stream_quota", "asof_by_key", "walkforward_rolling")


@pytest.mark.parametrize("name", PARITY)
def test_parity(spark, name):
    _same(spark, [name])


def test_every_query_has_sql_unless_none_can_say_it():
    without = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert all(n.startswith("op") or n == "pipeline" for n in without)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
