"""From finished runs to what may be shown: notes at the final trial count, the export snapshot, the suite's store."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import notes as note_ops
from tessera.operators import provenance, scoring
from tessera.plans.agent import Run
from tessera.plans.api import TRIAL_VARIANCE, ToolError, Tools, tool_schemas
from tessera.sources import sinks
from tessera.sources.sinks import plain

#: Under so many trading days a suite says nothing, and isn't stored.
LEAST_DAYS = 300
SNAPSHOT = 1
UNIVERSES = ("current", "point_in_time")


class PublishError(ValueError):
    """Why something isn't published or stored."""


def tool_results(run: Run) -> list[str]:
    """What a run was shown and may repeat: the tools' schemas, and every result."""
    shown = [c for m in run.messages if isinstance(m.get("content"), list) for c in m["content"] if isinstance(c, dict) and c.get("type") == "tool_result"]
    return [json.dumps(tool_schemas()), *(str(c.get("content", "")) for c in shown)]


def check_run(tools: Tools, run: Run) -> DataFrame:
    """The numerals of a run's answer with their status, those that no result has with their context."""
    spark = tools.store.bars.sparkSession
    answer = spark.createDataFrame([("run", run.answer)], "id string, text string")
    results = spark.createDataFrame([("run", t) for t in tool_results(run)], "id string, text string")
    return provenance.check(answer, results, "id")


def note_from_run(tools: Tools, run: Run, question: str, eval_key: str | None = None, now: dt.datetime | None = None) -> dict[str, Any]:
    """A finished run as a note.

    Every backtest is analysed again, at the number of trials that the session ended with: one that was analysed
    early would stay deflated by fewer. What can't be analysed is there with the reason.
    """
    session = tools.session
    trials, records = session.n_backtests, []
    for handle in session.handles("backtest"):
        made = dict(session.artifacts[handle].digest)
        try:
            found, problem = tools.analyze_results(handle, trials), None
        except ToolError as e:
            found, problem = {}, str(e)
        records.append({
            "handle": handle, "variant": f"{made['feature']}, {made['n_buckets']} buckets", "long_short": made["long_short"], "prediction_declared": made["prediction_declared"], "sharpe": made["sharpe"],
            "sharpe_annualised": found.get("sharpe_annualised"), "runs_as_predicted": found.get("runs_as_predicted"), "clears_confirmation_gate": found.get("clears_confirmation_gate"),
            "prob_beats_best_of_n_trials": found.get("prob_beats_best_of_n_trials"), "analysed": bool(found), "half_sharpes": [made["halves"][k] for k in sorted(made["halves"])],
            "costs": {int(k): v for k, v in made["costs"].items()}, "metrics": made, "statistics": found, "analysis_error": problem,
        })
    unverified = [r.literal for r in check_run(tools, run).where("status = 'unverified'").orderBy("pos").collect()]
    universes = sorted({r["metrics"]["universe"] for r in records})
    assumed = {"trial_variance": TRIAL_VARIANCE, "trial_variance_is_assumed": True, "n_trials_for_deflation": trials, "universes": universes, "survivorship_bias_present": universes != ["point_in_time"]}
    return plain({
        "note_id": uuid.uuid4().hex, "eval_key": eval_key, "created_at": now or dt.datetime.now(dt.timezone.utc), "source": "research", "hypothesis": question, "prose": run.answer, "stop_reason": run.stop_reason,
        "completed": run.completed, "called_required_tool": run.analysed, "unverified": unverified, "hidden": False, "backtests": records, "assumptions": assumed,
        "run": {"turns": run.turns, "tokens": run.tokens, "tool_sequence": run.sequence, "n_tool_errors": run.errors, "n_backtests": trials},
    })


def build_snapshot(verdicts: DataFrame, notes: DataFrame, survivorship: DataFrame | None = None, commit: str | None = None, partial: bool = False, now: dt.datetime | None = None) -> dict[str, Any]:
    """All that a page renders, as one JSON-safe document; an error if anything forbids publishing it.

    verdicts are a store's rows (one an anomaly and universe, schemas.VERDICTS), notes as notes.NOTE, survivorship the
    rows of scoring.survivorship_gap. With partial, missing verdicts are listed instead of forbidden.
    """
    spark = verdicts.sparkSession
    problems = scoring.snapshot_problems(verdicts, scoring.digest(), UNIVERSES, scoring.registry(spark))
    if partial:
        problems = problems.where("problem <> 'missing'")
    if found := problems.orderBy("problem", "eval_key", "universe").collect():  # a few of a dozen rows
        raise PublishError("; ".join(f"{r.problem}: {r.eval_key}/{r.universe}" for r in found))
    rows = {(r.eval_key, r.universe): plain(r.asDict(recursive=True)) for r in verdicts.collect()}  # a dozen, as the check has shown
    table, missing = [], []
    for a in scoring.ANOMALIES:
        sides = {u: rows.get((a.key, u)) for u in UNIVERSES}
        missing += [f"{a.key}/{u}" for u in UNIVERSES if sides[u] is None]
        values = [s and s.get("oriented_sharpe") for s in sides.values()]
        gap = values[0] - values[1] if None not in values else None
        about = {k: getattr(a, k) for k in ("key", "feature", "direction", "published_sharpe", "min_history_days", "citation")}
        table.append({**about, "results": sides, "survivorship_sharpe_gap": gap})
    tallies = {u: {v: sum(r["verdict"] == v for (_, x), r in rows.items() if x == u) for v in scoring.VERDICTS} for u in UNIVERSES}
    counts = note_ops.counts(notes).first()
    shown = note_ops.public(notes).orderBy(F.desc("created_at"), "note_id")
    return plain({
        "snapshot_version": SNAPSHOT, "generated_at": (now or dt.datetime.now(dt.timezone.utc)).replace(microsecond=0), "code_commit": commit, "registry_sha": scoring.digest(),
        "scoring": {"rule_version": scoring.RULES, "deflation_threshold": scoring.GATE, "fdr_alpha": scoring.ALPHA, "implausible_multiple": scoring.IMPLAUSIBLE, "trial_variance_assumed": TRIAL_VARIANCE},
        "evals": {"universes": UNIVERSES, "last_run_at": max((r["run_at"] for r in rows.values() if r.get("run_at")), default=None), "tally": tallies, "missing": sorted(missing), "anomalies": table},
        "notes": {"counts": counts.asDict(), "items": [r.asDict(recursive=True) for r in shown.collect()]},  # what a page lists
        "survivorship": None if survivorship is None else [r.asDict() for r in survivorship.orderBy("metric").collect()],
    })


def store_suite(scores: DataFrame, universe: str, days: int, path: str, now: dt.datetime | None = None) -> int:
    """Puts a suite's verdicts in the store, the newest of each anomaly and universe staying; refuses a panel of under LEAST_DAYS days."""
    if days < LEAST_DAYS:
        raise PublishError(f"the panel has {days} trading days, {LEAST_DAYS} are needed: verdicts without data look like verdicts")
    spark = scores.sparkSession
    new = scores.select(
        F.col("key").alias("eval_key"), F.lit(universe).alias("universe"), F.lit(now or dt.datetime.now(dt.timezone.utc)).cast("timestamp").alias("run_at"), F.lit(scoring.digest()).alias("registry_sha"), F.lit(scoring.RULES).alias("rule_version"),
        "verdict", "direction", "oriented_sharpe", "published_sharpe", "p_value", "p_value_adjusted", "deflated_psr", "n_trials", "reasons",
    )
    try:
        new = sinks.upsert(spark.read.parquet(path), new, sinks.VERDICT_KEYS, "run_at")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    sinks.replace_table(new, path)
    return spark.read.parquet(path).where(F.col("universe") == universe).count()


def check_store(rows: DataFrame) -> list[str]:
    """What is wrong with a store: keys that repeat, and verdicts of a registry that has since changed."""
    twice = rows.groupBy(*sinks.VERDICT_KEYS).count().where("count > 1").orderBy(*sinks.VERDICT_KEYS).limit(20).collect()
    old = scoring.stale(rows, scoring.digest()).select(*sinks.VERDICT_KEYS).distinct().orderBy(*sinks.VERDICT_KEYS).limit(20).collect()
    return [f"repeated: {r.eval_key}/{r.universe}" for r in twice] + [f"stale: {r.eval_key}/{r.universe}" for r in old]
