"""The pre-registered suite's verdicts, and the stored rows they become."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.stats import correct

#: The rules' version, the gate on the deflated probability, the false discovery rate, and how many times the
#: published level is implausible.
RULES, GATE, ALPHA, IMPLAUSIBLE = 1, 0.95, 0.05, 3.0
VERDICTS = ("pass", "partial", "fail", "insufficient_data")
HASHED = ("key", "feature", "direction", "published_sharpe", "min_history_days")


@dataclass(frozen=True)
class Anomaly:
    """A prediction fixed before any result: which end wins (direction +1 the top, -1 the bottom), and by how much."""

    key: str
    feature: str
    direction: int
    published_sharpe: float
    min_history_days: int
    citation: str = ""

    def __post_init__(self) -> None:
        if self.direction not in (1, -1) or self.published_sharpe <= 0 or self.min_history_days < 1:
            raise ValueError(f"{self.key}: direction is +1 or -1, the published level and the history positive")


#: The six registered predictions.
ANOMALIES = (
    Anomaly("momentum_12_1", "mom_12_1", 1, 0.50, 252, "Jegadeesh & Titman (1993)"),
    Anomaly("short_term_reversal", "ret_21d", -1, 0.35, 21, "Jegadeesh (1990)"),
    Anomaly("long_term_reversal", "rev_36_12", -1, 0.20, 756, "De Bondt & Thaler (1985)"),
    Anomaly("low_volatility", "vol_63d", -1, 0.78, 63, "Ang, Hodrick, Xing & Zhang (2006)"),
    Anomaly("idiosyncratic_volatility", "ivol_63d", -1, 0.60, 63, "Ang, Hodrick, Xing & Zhang (2006)"),
    Anomaly("fifty_two_week_high", "pct_52w_high", 1, 0.55, 252, "George & Hwang (2004)"),
)

MEASUREMENT = "key string, realised_sharpe double, p_value double, deflated_psr double, history_days int, n_invested_days int, n_trials int, tested boolean, note string"


def get(key: str) -> Anomaly:
    for a in ANOMALIES:
        if a.key == key:
            return a
    raise KeyError(f"no anomaly {key!r}; registered: {', '.join(a.key for a in ANOMALIES)}")


def digest(anomalies: Sequence[Anomaly] = ANOMALIES) -> str:
    """SHA-256 of what was predicted: independent of the order of rows and fields, blind to the rest."""
    rows = [{f: asdict(a)[f] for f in HASHED} for a in sorted(anomalies, key=lambda a: a.key)]
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def registry(spark: SparkSession, anomalies: Sequence[Anomaly] = ANOMALIES) -> DataFrame:
    rows = [(i, a.key, a.feature, a.direction, a.published_sharpe, a.min_history_days) for i, a in enumerate(anomalies)]
    return spark.createDataFrame(rows, "seq int, key string, feature string, direction int, published_sharpe double, min_history_days int")


def _text(pattern: str, *columns: Column) -> Column:
    return F.format_string(pattern, *columns)


def score_suite(measurements: DataFrame, anomalies: DataFrame, whole: bool = False) -> DataFrame:
    """A verdict with its reasons for every registered anomaly, in one plan.

    Rules in order, the first that fails decides: enough data; the sign; the deflated probability; the
    Benjamini-Hochberg adjusted p-value, over the testable ones only; and a pass that is implausibly large is
    partial. What wasn't measured doesn't pass. An anomaly without a measurement is an error,
    which is looked for unless the measurements are known to be whole.
    """
    if not whole and (missing := [r.key for r in anomalies.join(measurements, "key", "left_anti").collect()]):  # a handful
        raise KeyError(f"no measurement for {', '.join(sorted(missing))}: a part of a suite can't be scored")
    rows = anomalies.join(measurements, "key")
    measured = F.col("tested") & F.col("realised_sharpe").isNotNull()
    history, held = F.col("history_days") >= F.col("min_history_days"), F.col("n_invested_days") >= 1
    testable = measured & F.col("p_value").isNotNull() & history & held
    rows = correct(rows.withColumn("_p", F.when(testable, F.col("p_value"))), ALPHA, "_p").withColumnRenamed("bh_adj", "p_value_adjusted")
    oriented = F.when(measured & history & held, F.col("realised_sharpe") * F.col("direction"))
    rows = rows.withColumn("oriented_sharpe", oriented).withColumn("ratio", F.col("oriented_sharpe") / F.col("published_sharpe"))
    s, d, p, ratio = F.col("oriented_sharpe"), F.col("deflated_psr"), F.col("p_value_adjusted"), F.col("ratio")
    sign, gated, corrected = s > 0, d.isNotNull() & (d >= GATE), p.isNotNull() & (p <= ALPHA)
    enough = measured & history & held
    verdict = F.when(~enough, "insufficient_data").when(~sign | ~gated | ~corrected, "fail").when(ratio > IMPLAUSIBLE, "partial").otherwise("pass")
    side = F.when(F.col("direction") == 1, "top").otherwise("bottom")
    reasons = F.array(
        F.when(~measured, F.concat(F.lit("not tested: "), F.coalesce("note", F.lit("the feature has no values on this panel")))),
        F.when(measured & ~history, _text("history: %d days are needed, the panel has %d", F.col("min_history_days"), F.col("history_days"))),
        F.when(measured & history & ~held, F.lit("no position was ever held")),
        F.when(enough, _text("sign: the oriented Sharpe ratio is %+.3f, predicted for the %s bucket", s, side)),
        F.when(enough & sign & d.isNull(), F.lit("deflation: no probability was computed, which doesn't meet the gate")),
        F.when(enough & sign & d.isNotNull(), _text("deflation: probability %.3f of beating the best of %d trials, gate %.2f", d, F.col("n_trials"), F.lit(GATE))),
        F.when(enough & sign & gated & p.isNull(), F.lit("multiplicity: there is no p-value to correct")),
        F.when(enough & sign & gated & p.isNotNull(), _text("multiplicity: adjusted p-value %.4f against %.2f", p, F.lit(ALPHA))),
        F.when(verdict.isin("pass", "partial"), _text("magnitude: %.1f times the published level", ratio)),
    )
    out = rows.withColumn("verdict", verdict).withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return out.drop("_p", "holm_adj", "bh_reject", "holm_reject").withColumnRenamed("ratio", "sharpe_ratio_to_published")


def tally(spark: SparkSession, scores: DataFrame) -> DataFrame:
    """(verdict, n) of all four outcomes, none left out."""
    outcomes = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    counts = scores.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return outcomes.join(counts, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def universe_gap(current: DataFrame, pit: DataFrame, value: str = "oriented_sharpe") -> DataFrame:
    """(key, current, pit, gap) of the scores in two universes; the gap is null if either is."""
    sides = [d.select("key", F.col(value).alias(n)) for d, n in ((current, "current"), (pit, "pit"))]
    return sides[0].join(sides[1], "key").withColumn("gap", F.col("current") - F.col("pit"))


def survivorship_gap(current: DataFrame, pit: DataFrame) -> DataFrame:
    """(metric, current, pit, gap) of two summary rows."""
    names = ("total_return", "cagr", "ann_vol", "sharpe", "max_drawdown", "n_days")
    stack = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    sides = [d.selectExpr(f"stack({len(names)}, {stack}) as (metric, {n})") for d, n in ((current, "current"), (pit, "pit"))]
    return sides[0].join(sides[1], "metric").withColumn("gap", F.col("current") - F.col("pit"))


def stale(rows: DataFrame, sha: str) -> DataFrame:
    return rows.where(~F.col("registry_sha").eqNullSafe(F.lit(sha)))


def snapshot_problems(rows: DataFrame, sha: str, universes: Sequence[str], anomalies: DataFrame) -> DataFrame:
    """(problem, eval_key, universe): whatever forbids publishing stored verdicts; empty if nothing does."""
    spark = rows.sparkSession
    wanted = anomalies.select(F.col("key").alias("eval_key")).crossJoin(spark.createDataFrame([(u,) for u in universes], "universe string"))
    both = ["eval_key", "universe"]
    problem = lambda d, name: d.select(F.lit(name).alias("problem"), *both)
    versions = rows.select("rule_version").distinct().agg(F.count(F.lit(1)).alias("_n"))
    found = problem(wanted.join(rows, both, "left_anti"), "missing")
    found = found.unionByName(problem(rows.join(wanted, both, "left_anti"), "unknown"))
    found = found.unionByName(problem(stale(rows, sha), "stale"))
    found = found.unionByName(problem(rows.where(~F.col("verdict").isin(*VERDICTS)), "unknown_verdict"))
    return found.unionByName(problem(rows.crossJoin(F.broadcast(versions)).where("_n > 1"), "mixed_rules"))


def json_safe(column: Column) -> Column:
    """NaN and infinities as null, as JSON has none."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def newest(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
