"""The tool API: four validated calls over handles. Each composes one lazy plan and takes one small digest of it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import diagnostics, engine, features, membership, metrics, quality, stats
from tessera.plans.session import Session, SessionError
from tessera.plans.suite import TRIAL_VARIANCE
from tessera.sources import readers
from tessera.sources.shared import steady, stored
from tessera.sources.sinks import plain

UNIVERSES, REBALANCES, PREDICTIONS = ("current", "point_in_time"), ("monthly",), ("top_beats_bottom", "bottom_beats_top")
GATE = 0.95


class ToolError(Exception):
    """A call that can be corrected: the text says how."""


@dataclass(frozen=True)
class Parameter:
    kind: type | tuple[type, ...]
    required: bool = False
    choices: tuple | None = None
    low: float | None = None
    high: float | None = None
    about: str = ""


#: One table for the published schemas and for validation.
TOOLS: dict[str, dict[str, Parameter]] = {
    "fetch_data": {
        "tickers": Parameter(list, True, about="tickers; an empty list means all"),
        "start": Parameter(str, True, about="first day, YYYY-MM-DD"),
        "end": Parameter(str, True, about="last day, YYYY-MM-DD"),
        "universe": Parameter(str, choices=UNIVERSES, about="who is ranked: today's names, or each day's members"),
    },
    "compute_feature": {"handle": Parameter(str, True, about="a panel"), "feature": Parameter(str, True, choices=tuple(features.MENU), about="a feature of the menu")},
    "run_backtest": {
        "handle": Parameter(str, True, about="a feature"),
        "n_buckets": Parameter(int, low=2, high=20, about="buckets that each date is ranked into"),
        "long_short": Parameter(bool, about="short the bottom bucket too"),
        "rebalance": Parameter(str, choices=REBALANCES, about="how often"),
        "cost_bps": Parameter((int, float), low=0, high=100, about="cost of a unit of turnover"),
        "prediction": Parameter(str, choices=PREDICTIONS, about="which end should win, declared before the result"),
    },
    "analyze_results": {"handle": Parameter(str, True, about="a backtest"), "n_trials": Parameter(int, low=1, about="trials to deflate by; never fewer than were run")},
}


def tool_schemas() -> list[dict]:
    names = {list: "array", str: "string", int: "integer", bool: "boolean"}

    def one(p: Parameter) -> dict:
        out = {"type": names.get(p.kind, "number"), "description": p.about}
        extra = {"enum": list(p.choices) if p.choices else None, "minimum": p.low, "maximum": p.high}
        return out | {k: v for k, v in extra.items() if v is not None}

    return [{"name": t, "input_schema": {"type": "object", "properties": {k: one(p) for k, p in ps.items()}, "required": [k for k, p in ps.items() if p.required]}} for t, ps in TOOLS.items()]


def validate(tool: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """The arguments as they are, or a ToolError: unknown tool, unknown or missing arguments, types, values, in this order."""
    if tool not in TOOLS:
        raise ToolError(f"unknown tool {tool!r}; there are: {', '.join(TOOLS)}")
    spec = TOOLS[tool]
    if unknown := sorted(set(arguments) - set(spec)):
        raise ToolError(f"{tool}: unknown arguments {', '.join(unknown)}; it takes: {', '.join(spec)}")
    if missing := sorted(k for k, p in spec.items() if p.required and k not in arguments):
        raise ToolError(f"{tool}: missing arguments {', '.join(missing)}")
    for k, v in arguments.items():
        p = spec[k]
        if isinstance(v, bool) and p.kind is not bool or not isinstance(v, p.kind):
            raise ToolError(f"{tool}.{k}: {type(v).__name__} is the wrong type")
    for k, v in arguments.items():
        p = spec[k]
        if p.choices and v not in p.choices:
            raise ToolError(f"{tool}.{k}: {v!r} isn't one of: {', '.join(map(str, p.choices))}")
        if p.low is not None and v < p.low or p.high is not None and v > p.high:
            raise ToolError(f"{tool}.{k}: {v} is out of range")
    return arguments


@dataclass(frozen=True)
class Panel:
    """A frame with the universe it is for; members are the pairs (ts, ticker) that may be ranked, None for all."""

    frame: DataFrame
    universe: str
    members: DataFrame | None = None
    feature: str | None = None


@dataclass(frozen=True)
class Store:
    """Where bars and snapshots come from, and which ticker is the market."""

    bars: DataFrame
    snapshots: DataFrame
    market: str = "SPY"


class Tools:
    def __init__(self, store: Store, session: Session | None = None):
        steady(store.bars.sparkSession)
        self.store, self.session = store, session or Session()
        self.calls: dict[str, Callable[..., dict]] = {"fetch_data": self.fetch_data, "compute_feature": self.compute_feature, "run_backtest": self.run_backtest, "analyze_results": self.analyze_results}

    def dispatch(self, tool: str, arguments: dict[str, Any]) -> dict:
        """Validates and runs a call; whatever fails is a ToolError."""
        validate(tool, arguments)
        try:
            return self.calls[tool](**arguments)
        except (ToolError, SessionError) as e:
            raise ToolError(str(e)) from e
        except Exception as e:
            raise ToolError(f"{tool} failed: {type(e).__name__}: {str(e)[:300]}") from e

    def fetch_data(self, tickers: list, start: str, end: str, universe: str = "current") -> dict:
        raw = readers.load_prices(self.store.bars, tickers=tickers, start=start, end=end)
        gated, report = quality.truncate_suspects(raw)
        kept, _ = quality.trim_ragged_end(gated)
        kept = stored(kept, "panel")
        found = kept.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"), F.count_distinct("ts").alias("n_days"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).first().asDict()
        if not found["n_rows"]:
            raise ToolError("no bars for these tickers and days")
        members = None
        if universe == "point_in_time":
            if self.store.snapshots.select("as_of").distinct().limit(2).count() < 2:
                raise ToolError("a point-in-time universe needs at least two snapshots")
            members = stored(membership.membership_panel(self.store.snapshots, kept.select("ts").distinct()), "members")
            if members.isEmpty():
                raise ToolError("no snapshot is in force on any of these days")
        digest = {"universe": universe, **plain(found), "n_cut_by_quality_gate": report.count()}
        return self.session.put("panel", Panel(kept, universe, members), digest)

    def compute_feature(self, handle: str, feature: str) -> dict:
        panel: Panel = self.session.get(handle, "panel")
        add, column = features.MENU[feature]
        if feature == "ivol_63d":
            add = features.idiosyncratic_volatility(63, self.store.market)
        out = stored(panel.frame.transform(add).select("ticker", "ts", "close", F.col(column).alias("value")), "feature")
        found = out.agg(F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("ticker"))).alias("n_tickers")).first().asDict()
        if not found["n_values"]:
            raise ToolError(f"{feature} has no values on this panel: is its history long enough, and its market there?")
        return self.session.put("feature", Panel(out, panel.universe, panel.members, feature), {"feature": feature, "universe": panel.universe, **found})

    def run_backtest(self, handle: str, n_buckets: int = 10, long_short: bool = True, rebalance: str = "monthly", cost_bps: float = 10.0, prediction: str | None = None) -> dict:
        panel: Panel = self.session.get(handle, "feature")
        prices = panel.frame.select("ticker", "ts", "close")
        plain_signal = panel.frame.where(F.col("ticker") != self.store.market).select("ts", "ticker", F.col("value").alias("sig")).where("sig is not null")
        if panel.members is not None:  # before ranking
            plain_signal = membership.restrict(plain_signal, panel.members)
        signal = plain_signal.withColumn("sig", -F.col("sig")) if prediction == PREDICTIONS[1] else plain_signal
        weights = stored(engine.signal_weights(signal, prices.select("ts").distinct(), n_buckets, long_short), "weights")
        b = engine.run_backtest(prices, weights, float(cost_bps))
        held = stored(engine.invested(b.returns, b.weights), "returns")
        six = metrics.summary(held).first().asDict()
        if not six["n_days"]:
            raise ToolError("the strategy never holds a position on this panel")
        ends = engine.month_ends(plain_signal.select("ts").distinct())
        buckets = stored(diagnostics.bucket_returns(prices, plain_signal, ends, weights, n_buckets), "buckets")
        halves = {f"half_{r.half}": r.sharpe for r in diagnostics.halves(held).collect()}
        digest = {
            "feature": panel.feature, "universe": panel.universe, "n_buckets": n_buckets, "long_short": long_short, "prediction": prediction, "prediction_declared": prediction is not None,
            **{k: None if v is None else round(v, 6) for k, v in six.items()}, "buckets": {str(r.bucket): round(r.ann_return, 4) for r in buckets.orderBy("bucket").collect()},
            "monotonicity": diagnostics.monotonicity(buckets).first().rho, "halves": halves, "costs": {str(r.cost_bps): r.sharpe for r in diagnostics.cost_grid(held, b.turnover).collect()},
        }
        return self.session.put("backtest", held, plain(digest))

    def analyze_results(self, handle: str, n_trials: int | None = None) -> dict:
        """Deflated statistics of a backtest, by the trials named or those that the session has seen, whichever are more."""
        held: DataFrame = self.session.get(handle, "backtest")
        used = max(n_trials or 1, self.session.n_backtests)
        m = stats.moments(held).first()
        if m.sr is None:
            raise ToolError("the returns are too few or don't vary: there is nothing to analyse")
        try:
            length = round(stats.min_track_record_length(m.sr, m.skew, m.kurt), 1)
            note = None
        except ValueError as e:
            length, note = None, str(e)
        dsr = stats.deflated_sharpe(m.sr, m.skew, m.kurt, m.n, used, TRIAL_VARIANCE)
        digest = {
            "backtest": handle, "sharpe_annualised": round(m.sr * math.sqrt(252), 4), "skew": round(m.skew, 4), "kurtosis": round(m.kurt, 4), "n_observations": m.n,
            "prob_sharpe_above_zero": round(stats.probabilistic_sharpe(m.sr, m.skew, m.kurt, m.n), 4), "prob_beats_best_of_n_trials": round(dsr, 4),
            "expected_best_of_n_trials": round(stats.expected_max_sharpe(used, TRIAL_VARIANCE), 6), "min_track_record_length_days": length, "n_trials_used": used, "trial_variance_assumed": TRIAL_VARIANCE,
            "clears_confirmation_gate": dsr >= GATE, "runs_as_predicted": m.sr > 0,
        }
        return self.session.put("analysis", digest, digest | ({"note": note} if note else {}))


def run_suite(tools: Tools, universe: str, start: str, end: str, n_buckets: int = 10) -> list[dict]:
    """All registered anomalies in one session: every backtest first, then every analysis, so all are deflated by the same number."""
    from tessera.operators.scoring import ANOMALIES

    panel = tools.dispatch("fetch_data", {"tickers": [], "start": start, "end": end, "universe": universe})["handle"]
    out: list[dict] = []
    for a in ANOMALIES:
        try:
            feature = tools.dispatch("compute_feature", {"handle": panel, "feature": a.feature})["handle"]
            made = tools.dispatch("run_backtest", {"handle": feature, "n_buckets": n_buckets, "prediction": PREDICTIONS[a.direction < 0]})
            out.append({"key": a.key, "backtest": made})
        except ToolError as e:
            out.append({"key": a.key, "error": str(e)})
    for row in out:
        if "backtest" in row:
            try:
                row["analysis"] = tools.dispatch("analyze_results", {"handle": row["backtest"]["handle"]})
            except ToolError as e:
                row["error"] = str(e)
    return out
