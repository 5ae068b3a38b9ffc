"""Notes from runs, the export snapshot, the suite's store, and what surrounds a numeral."""

import datetime as dt
import json
import math
import re

import pytest

from tessera.operators import membership, notes, provenance, scoring
from tessera.plans import agent, api, publishing
from tessera.sources import readers, schemas
from tests.helpers import rows, weekdays

NOW = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)


def tools_of(panel_of, spark, n=330):
    closes = {f"T{i:02}": [100 * math.exp(0.0004 * (i - 3) * j) * (1 + 0.05 * math.sin(0.11 * j + 0.7 * i)) for j in range(n)] for i in range(6)}
    return api.Tools(api.Store(panel_of(closes), schemas.empty(spark, schemas.SNAPSHOTS), "T00")), [str(d) for d in weekdays(n)]


def test_a_note_is_deflated_by_all_trials_of_its_run(spark, panel_of):
    tools, days = tools_of(panel_of, spark)
    calls = [("fetch_data", {"tickers": [], "start": days[0], "end": days[-1]}), ("compute_feature", {"handle": "panel_1", "feature": "ret_21d"})]
    calls += [("run_backtest", {"handle": "feature_1", "n_buckets": 2, "prediction": "top_beats_bottom"}), ("analyze_results", {"handle": "backtest_1"}), ("run_backtest", {"handle": "feature_1", "n_buckets": 3})]
    told = max(int(x) for x in re.findall(r"\d+", json.dumps(api.tool_schemas())))  # a figure of the tools' schemas
    assert told > 12
    left = [agent.Reply("", [("1", *c)]) for c in calls]
    shown = []

    def client(messages, schemas_):
        if left:
            return left.pop(0)
        shown.extend(r["content"] for m in messages if isinstance(m["content"], list) for r in m["content"])
        sharpe = json.loads(shown[3])["sharpe_annualised"]
        return agent.Reply(f"The annual ratio is {sharpe}; costs of up to {told} are allowed.\nIt would beat 987.65 of them.")

    run = agent.run(client, tools, "Do recent winners win?")
    note = publishing.note_from_run(tools, run, "Do recent winners win?", now=NOW)
    early = json.loads(shown[3])
    first, second = note["backtests"]
    assert early["n_trials_used"] == 1 and first["statistics"]["n_trials_used"] == second["statistics"]["n_trials_used"] == 2 == note["assumptions"]["n_trials_for_deflation"]
    assert first["statistics"]["expected_best_of_n_trials"] > early["expected_best_of_n_trials"] == 0
    assert note["unverified"] == ["987.65"] and note["completed"] and note["called_required_tool"] and note["run"]["n_backtests"] == 2
    assert note["assumptions"]["survivorship_bias_present"] and json.loads(json.dumps(note)) == note
    quoted = {r.literal: r.context for r in publishing.check_run(tools, run).join(provenance.contexts(spark.createDataFrame([("run", run.answer)], "id string, text string"), "id"), ["id", "pos"]).collect()}
    at = run.answer.index("987.65")
    assert quoted["987.65"] == run.answer[at - 40 : at + 46].replace("\n", " ")


def verdicts(spark, drop=(), **change):
    base = dict(run_at=NOW, registry_sha=scoring.digest(), rule_version=scoring.RULES, verdict="fail", direction=1, oriented_sharpe=0.5, published_sharpe=0.5, p_value=0.1, p_value_adjusted=0.2, deflated_psr=0.3, n_trials=6, reasons=["sign"])
    found = [{"eval_key": a.key, "universe": u, **base, "oriented_sharpe": 0.5 if u == "current" else 0.2, **change} for a in scoring.ANOMALIES for u in publishing.UNIVERSES if (a.key, u) not in drop]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schemas.VERDICTS.split(", ")) for r in found], schemas.VERDICTS)


def some_notes(spark):
    made = [("a", None, NOW, "research", "q", "end_turn", True, True, [], False, []), ("b", "momentum_12_1", NOW + dt.timedelta(1), "research", "q", "end_turn", True, True, ["1"], False, []),
            ("c", "momentum_12_1", NOW + dt.timedelta(2), "research", "q", "end_turn", True, True, [], False, []), ("d", None, NOW, "live", "q", "end_turn", True, True, [], True, [])]
    return spark.createDataFrame(made, notes.NOTE)


def test_the_snapshot_is_whole_or_refused(spark):
    got = publishing.build_snapshot(verdicts(spark), some_notes(spark), commit="abc", now=NOW)
    assert got["registry_sha"] == scoring.digest() and got["evals"]["tally"]["current"]["fail"] == 6 and not got["evals"]["missing"]
    assert all(math.isclose(a["survivorship_sharpe_gap"], 0.3) for a in got["evals"]["anomalies"])
    assert [n["note_id"] for n in got["notes"]["items"]] == ["c", "a"] and got["notes"]["counts"] == {"total": 4, "publishable": 3, "unpublishable": 1}
    json.dumps(got)
    hole = verdicts(spark, drop={("low_volatility", "current")})
    with pytest.raises(publishing.PublishError, match="missing: low_volatility/current"):
        publishing.build_snapshot(hole, some_notes(spark))
    partial = publishing.build_snapshot(hole, some_notes(spark), partial=True)
    assert partial["evals"]["missing"] == ["low_volatility/current"] and sum(a["survivorship_sharpe_gap"] is None for a in partial["evals"]["anomalies"]) == 1
    for bad in ({"registry_sha": "old"}, {"verdict": "maybe"}):
        with pytest.raises(publishing.PublishError):
            publishing.build_snapshot(verdicts(spark, **bad), some_notes(spark), partial=True)


def test_the_store_refuses_short_panels_and_knows_stale_rows(spark, tmp_path):
    scores = verdicts(spark).where("universe = 'current'").withColumnRenamed("eval_key", "key").drop("universe", "run_at", "registry_sha", "rule_version")
    path = str(tmp_path / "verdicts")
    with pytest.raises(publishing.PublishError, match="299 trading days"):
        publishing.store_suite(scores, "current", 299, path)
    assert publishing.store_suite(scores, "current", 300, path, NOW) == 6
    assert publishing.store_suite(scores.limit(2), "current", 300, path, NOW + dt.timedelta(1)) == 6
    assert publishing.store_suite(scores, "point_in_time", 300, path, NOW) == 6
    rows_ = spark.read.parquet(path)
    assert publishing.check_store(rows_) == [] and rows_.count() == 12
    assert publishing.check_store(verdicts(spark, registry_sha="old"))[0] == "stale: fifty_two_week_high/current"
    assert publishing.check_store(rows_.unionByName(rows_.limit(1)))[0].startswith("repeated: ")


def test_notes_by_id_and_key(spark):
    n = some_notes(spark)
    assert [r.note_id for r in notes.by_id(n, "b").collect()] == ["b"] and notes.by_id(n, "x").count() == 0
    assert [r.note_id for r in notes.by_key(n, "momentum_12_1").collect()] == ["c"]
    assert [r.note_id for r in notes.recent(n, 2).collect()] == ["c", "b"]


def test_membership_diagnostics(spark):
    d = lambda s: dt.date.fromisoformat(s)
    snaps = spark.createDataFrame([(t, "x", d(s)) for s, names in (("2024-01-01", "AB"), ("2024-01-31", "AB"), ("2024-06-01", "AC"), ("2024-06-11", "AC"), ("2025-01-01", "AC")) for t in names], schemas.SNAPSHOTS)
    days = spark.createDataFrame([(x,) for x in weekdays(130)], "ts date")  # to the end of June 2024
    assert rows(membership.long_gaps(snaps, days)) == [(d("2024-01-31"), d("2024-06-01"), 122, True), (d("2024-06-11"), d("2025-01-01"), 204, True)]
    early = spark.createDataFrame([(d("2024-05-01"),), (d("2024-06-05"),)], "ts date")
    assert [r[3] for r in rows(membership.long_gaps(snaps, early))] == [True, False]
    assert rows(membership.resolution(snaps, days)) == [(4, 30.0, 122)]
    member = membership.membership_panel(snaps, days)
    got = {(r.n_names, r.kind) for r in membership.day_clusters(member).collect()}
    assert got == {(1, "removed"), (1, "joined late")}


def test_a_long_csv_and_quoted_names(spark):
    text = "Name,Symbol\r\n" + "\r\n".join(f'"Co, {k}",{"ABCDEFGHIJ"[k // 10 % 10]}{"ABCDEFGHIJ"[k % 10]}' for k in range(20_000)) + "\n"
    got = readers.constituents_csv(spark.createDataFrame([(text,), ("x,y\n1,2",)], "csv_text string")).collect()
    assert len(got[0].symbols) == 100 and got[1].symbols == []
    listed = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")

    def broken():
        raise OSError("down")

    assert rows(readers.fetch_constituents(spark, [broken, lambda: listed], 2)) == [("AAA",), ("BBB",)]
    with pytest.raises(ValueError, match="at least 3"):
        readers.fetch_constituents(spark, [lambda: listed], 3)
    assert readers.snapshot_frame(listed, "x").where("as_of = current_date()").count() == 2
