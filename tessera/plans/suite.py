"""The registered suite: all anomalies, in both universes, in one plan keyed by universe and anomaly."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import normal
from tessera.operators import engine, features, membership, metrics, scoring, stats
from tessera.plans.adapters import CTES, MARKET, NEEDS, Inputs, strategy_ctes, with_clause
from tessera.plans.panels import LOGS, full, rounded
from tessera.plans.catalogue import query
from tessera.sources import sinks
from tessera.sources.shared import stored

#: The assumed variance of Sharpe ratios across trials; it is reported with every figure that rests on it.
TRIAL_VARIANCE = 0.0009
BUCKETS = 5
KEYS = ["universe", "anomaly"]


def signals(prices: DataFrame, market: str, anomalies: tuple[scoring.Anomaly, ...] = scoring.ANOMALIES, orient: bool = True) -> DataFrame:
    """(anomaly, ts, ticker, sig): every anomaly's feature in one pass over the panel; the market isn't ranked.

    Oriented, the end that the prediction says wins is on top, so the book is built and deflated as predicted.
    """
    out = prices
    for feature in dict.fromkeys(a.feature for a in anomalies):
        out = out.transform(features.idiosyncratic_volatility(63, market) if feature == "ivol_63d" else features.MENU[feature][0])
    rows = [F.struct(F.lit(a.key).alias("anomaly"), (F.col(features.MENU[a.feature][1]) * (a.direction if orient else 1)).alias("sig")) for a in anomalies]
    out = out.where(F.col("ticker") != market).select("ts", "ticker", F.explode(F.array(*rows)).alias("s"))
    return out.select("s.anomaly", "ts", "ticker", "s.sig").where(F.col("sig").isNotNull())


UNIVERSES = ("current", "point_in_time")


def measure(p: Inputs, orient: bool = True, universes: tuple[str, ...] = UNIVERSES) -> DataFrame:
    """Per universe and anomaly: sr, skew, kurt, n, sharpe of the invested days, and the panel's days."""
    found = signals(p.with_market, MARKET, orient=orient)
    found = stored(found, "signals") if len(universes) > 1 else found  # read by both
    sides = {"current": lambda: found, "point_in_time": lambda: membership.restrict(found, membership.membership_panel(p.snapshots, p.days))}
    rows = None
    for u in universes:
        side = sides[u]().withColumn("universe", F.lit(u))
        rows = side if rows is None else rows.unionByName(side)
    weights = stored(engine.signal_weights(rows, p.days, BUCKETS, by=KEYS), "weights")  # read by each step of the accounting
    b = engine.run_backtest(p.prices, weights, by=KEYS, forward=p.frame.select("ts", "ticker", "fwd_ret"))
    held = engine.invested(b.returns, b.weights, by=KEYS)
    history = p.days.agg(F.count(F.lit(1)).alias("history_days"))
    return stats.moments(held, by=KEYS, sharpe=metrics.sharpe()).crossJoin(F.broadcast(history))  # one row beside a dozen


def measurements(measured: DataFrame, spark: SparkSession, universe: str, orient: bool = True) -> DataFrame:
    """The suite's measurements in a universe; an anomaly that couldn't be measured is there, untested."""
    registry = scoring.registry(spark)
    rows = registry.select("key", "direction").join(measured.where(F.col("universe") == universe).withColumnRenamed("anomaly", "key"), "key", "left")
    n_trials = len(scoring.ANOMALIES)
    rows = stats.deflate(rows, n_trials, TRIAL_VARIANCE)
    sign = F.lit(1) if orient else F.col("direction")
    t = F.col("sharpe") * sign / math.sqrt(252) * F.sqrt(F.col("n").cast("double"))
    days = F.max("history_days").over(Window.partitionBy())  # over the registry's rows; the same in all that were measured
    return rows.select(
        "key", (F.col("sharpe") * (F.col("direction") if orient else F.lit(1))).alias("realised_sharpe"), (1 - normal.cdf_column(t)).alias("p_value"), F.col("dsr").alias("deflated_psr"),
        F.coalesce(days, F.lit(0)).cast("int").alias("history_days"), F.coalesce("n", F.lit(0)).cast("int").alias("n_invested_days"),
        F.lit(n_trials).alias("n_trials"), F.col("sharpe").isNotNull().alias("tested"), F.lit(None).cast("string").alias("note"),
    )


def score(p: Inputs, universe: str, orient: bool = True) -> DataFrame:
    measured = measure(p, orient, (universe,))
    return scoring.score_suite(measurements(measured, p.spark, universe, orient), scoring.registry(p.spark), whole=True)


# --- the same in SQL: a strategy per universe and anomaly ------------------------------------------------------

_FEATURE_SQL = {
    "mom_12_1": "SELECT ticker, ts, c21 / nullif(c252, 0) - 1 AS v FROM lagged",
    "ret_21d": "SELECT ticker, ts, close / nullif(c21, 0) - 1 AS v FROM lagged",
    "rev_36_12": "SELECT ticker, ts, c252 / nullif(c756, 0) - 1 AS v FROM lagged",
    "vol_63d": f"SELECT ticker, ts, {full('stddev_samp(x)', 'x', 63)} * sqrt(252e0) AS v FROM (SELECT *, ln(close / c1) AS x FROM lagged)",
    "ivol_63d": f"""SELECT ticker, ts, CASE WHEN mm > 0 AND rr - rm / mm * rm >= 0 AND ticker <> 'MKT' THEN sqrt((rr - rm / mm * rm) / 62e0) * sqrt(252e0) END AS v FROM (
        SELECT ticker, ts, {full('sum(x * x)', 'x * m', 63)} AS rr, {full('sum(x * m)', 'x * m', 63)} AS rm, {full('sum(m * m)', 'x * m', 63)} AS mm FROM (
        SELECT a.ticker, a.ts, a.x, b.x AS m FROM logs a LEFT JOIN (SELECT ts, x FROM logs WHERE ticker = 'MKT') b USING (ts)))""",
    "pct_52w_high": f"SELECT ticker, ts, close / {full('max(close)', 'close', 252)} AS v FROM bars",
}


def _suite_ctes() -> tuple[dict[str, str], dict[str, list[str]]]:
    ctes, needs, parts, used = dict(LOGS[0]), dict(LOGS[1]), [], []
    for a in scoring.ANOMALIES:
        ctes[f"f_{a.key}"], needs[f"f_{a.key}"] = f"SELECT ticker, ts, {a.direction} * v AS sig FROM ({_FEATURE_SQL[a.feature]}) WHERE ticker <> 'MKT'", ["lagged", "logs", "bars"]
        ctes[f"m_{a.key}"], needs[f"m_{a.key}"] = f"SELECT f.* FROM f_{a.key} f JOIN member USING (ts, ticker)", [f"f_{a.key}", "member"]
        for letter, universe in (("f", "current"), ("m", "point_in_time")):
            prefix = f"{letter}_{a.key}_"
            c, n = strategy_ctes(f"{letter}_{a.key}", BUCKETS, prefix=prefix)
            ctes |= c
            needs |= n
            used.append(f"{prefix}inv")
            parts.append(f"SELECT '{universe}' AS universe, '{a.key}' AS anomaly, {a.direction} AS direction, {a.published_sharpe}e0 AS published, ret FROM {prefix}inv")
    ctes["all_returns"], needs["all_returns"] = " UNION ALL ".join(parts), used
    ctes["measured"] = """SELECT universe, anomaly, direction, published, m / nullif(sd, 0) AS sr, m3 / pow(m2, 1.5e0) AS skew, m4 / (m2 * m2) AS kurt, n, m / nullif(sd, 0) * sqrt(252e0) AS sharpe FROM (
      SELECT universe, anomaly, any_value(direction) AS direction, any_value(published) AS published, any_value(m) AS m, any_value(sd) AS sd, CAST(count(*) AS BIGINT) AS n, avg(pow(ret - m, 2)) AS m2,
             avg(pow(ret - m, 3)) AS m3, avg(pow(ret - m, 4)) AS m4
      FROM (SELECT *, avg(ret) OVER g AS m, stddev_samp(ret) OVER g AS sd FROM all_returns WINDOW g AS (PARTITION BY universe, anomaly)) GROUP BY 1, 2)"""
    needs["measured"] = ["all_returns"]
    # the normal distribution's quantiles at 1 - 1/6, 1 - 1/(6e) and 0.95, from printed tables: nothing here is taken from the code under test
    emax = math.sqrt(TRIAL_VARIANCE) * ((1 - 0.5772156649015329) * 0.9674215661017014 + 0.5772156649015329 * 1.543842550450144)
    z = 1.644853626951472
    ctes["tested"] = f"""SELECT *, {phi('x0')} AS psr, {emax!r}e0 AS emax, {phi('x1')} AS dsr, CASE WHEN sr > 0 THEN 1 + spread * pow({z!r}e0 / sr, 2) END AS min_trl, 1 - {phi('t')} AS p FROM (
      SELECT *, sr * sqrt(n - 1) / sqrt(spread) AS x0, (sr - {emax!r}e0) * sqrt(n - 1) / sqrt(spread) AS x1, sr * sqrt(n) AS t FROM (SELECT *, 1 - skew * sr + (kurt - 1) / 4 * sr * sr AS spread FROM measured))"""
    needs["tested"] = ["measured"]
    ctes["adjusted"] = """SELECT *, least(1e0, min(m * p / j) OVER (PARTITION BY universe ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adj
      FROM (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY p, anomaly) AS j, count(*) OVER (PARTITION BY universe) AS m FROM tested)"""
    needs["adjusted"] = ["tested"]
    return ctes, needs


def phi(x: str) -> str:
    """The normal distribution function in SQL: the series of x^(2k+1) / (2k+1)!!, with the double factorial by the gamma function."""
    term = f"exp((2 * k + 1) * ln(abs({x})) - lgamma(2 * k + 2) + k * ln(2e0) + lgamma(k + 1))"
    return f"(CASE WHEN {x} = 0 THEN 0.5e0 ELSE 0.5e0 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum([{term} FOR k IN range(0, 80)]) END)"


SUITE = _suite_ctes()


@query(with_clause("SELECT universe, anomaly, round(sr, 8) AS sr, round(skew, 6) AS skew, round(kurt, 6) AS kurt, n, round(sharpe, 8) AS sharpe FROM measured", ["measured"], SUITE))
def suite_measure(p: Inputs) -> DataFrame:
    return rounded(rounded(measure(p), "sr", "sharpe"), "skew", "kurt", places=6).drop("history_days")


@query(with_clause("SELECT anomaly AS key, round(psr, 8) AS psr, round(emax, 8) AS emax, round(dsr, 8) AS dsr, round(min_trl, 4) AS min_trl, round(p, 8) AS p FROM tested WHERE universe = 'current'", ["tested"], SUITE))
def deflated(p: Inputs) -> DataFrame:
    rows = measure(p, universes=("current",)).withColumnRenamed("anomaly", "key")
    out = stats.deflate(rows, len(scoring.ANOMALIES), TRIAL_VARIANCE).select("key", "psr", "emax", "dsr", "min_trl", "p")
    return rounded(rounded(out, "psr", "emax", "dsr", "p"), "min_trl", places=4)


_VERDICT = "CASE WHEN sr <= 0 OR dsr < 0.95 OR adj > 0.05 THEN 'fail' WHEN sharpe / published > 3 THEN 'partial' ELSE 'pass' END"
_REASONS = "CASE WHEN sr <= 0 THEN 1 WHEN dsr < 0.95 THEN 2 WHEN adj > 0.05 THEN 3 ELSE 4 END"


@query(with_clause(f"SELECT anomaly AS key, {_VERDICT} AS verdict, {_REASONS} AS n_reasons, round(sharpe, 8) AS oriented_sharpe, round(adj, 8) AS p_value_adjusted FROM adjusted WHERE universe = 'point_in_time'", ["adjusted"], SUITE))
def suite_score(p: Inputs) -> DataFrame:
    out = score(p, "point_in_time")
    return rounded(out.select("key", "verdict", F.size("reasons").alias("n_reasons"), "oriented_sharpe", "p_value_adjusted"), "oriented_sharpe", "p_value_adjusted")


@query(with_clause(f"SELECT v AS verdict, CAST(count(key) AS BIGINT) AS n FROM (SELECT unnest(['pass', 'partial', 'fail', 'insufficient_data']) AS v) LEFT JOIN (SELECT anomaly AS key, {_VERDICT} AS x FROM adjusted WHERE universe = 'current') ON x = v GROUP BY 1", ["adjusted"], SUITE))
def verdict_tally(p: Inputs) -> DataFrame:
    return scoring.tally(p.spark, score(p, "current"))


@query(with_clause("SELECT a.anomaly AS key, round(a.sharpe, 8) AS current, round(b.sharpe, 8) AS pit, round(a.sharpe - b.sharpe, 8) AS gap FROM measured a JOIN measured b USING (anomaly) WHERE a.universe = 'current' AND b.universe = 'point_in_time'", ["measured"], SUITE))
def universe_gap(p: Inputs) -> DataFrame:
    measured = stored(measure(p), "measured").withColumnRenamed("anomaly", "key")
    sides = [measured.where(F.col("universe") == u) for u in ("current", "point_in_time")]
    return rounded(scoring.universe_gap(*sides, value="sharpe"), "current", "pit", "gap")


@query(with_clause("SELECT round(var_samp(sr), 12) AS var FROM measured WHERE universe = 'current'", ["measured"], SUITE))
def trial_variance(p: Inputs) -> DataFrame:
    return rounded(stats.trial_variance(measure(p, universes=("current",))), "var", places=12)


_P = "(({0} * 7919) % 9973 + 1) / 20000e0"


@query(f"""SELECT family, key, p, round(bh, 10) AS bh_adj, round(holm, 10) AS holm_adj, bh <= 0.05 + 1e-15 AS bh_reject, holm <= 0.05 + 1e-15 AS holm_reject FROM (
SELECT *, least(1e0, min(m * p / j) OVER (PARTITION BY family ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh, least(1e0, max((m - j + 1) * p) OVER (PARTITION BY family ORDER BY j)) AS holm FROM (
SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, key) AS j, count(*) OVER (PARTITION BY family) AS m FROM (SELECT p_brand AS family, p_partkey AS key, {_P.format('p_partkey')} AS p FROM part)))""")
def bh_holm(p: Inputs) -> DataFrame:
    """Each brand's parts as a family of tests, each corrected on its own."""
    rows = p.table("part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("key"), ((F.col("p_partkey") * 7919 % 9973 + 1) / 20000.0).alias("p"))
    return rounded(stats.correct(rows, by=("family",)), "bh_adj", "holm_adj", places=10)


_ROWS = "SELECT n_name AS eval_key, u AS universe, n_nationkey AS v FROM nation CROSS JOIN (SELECT unnest(['current', 'point_in_time']) AS u)"


def _verdict_rows(p: Inputs) -> tuple[DataFrame, DataFrame]:
    rows = p.table("nation").select(F.col("n_name").alias("eval_key"), F.explode(F.array(F.lit("current"), F.lit("point_in_time"))).alias("universe"), F.col("n_nationkey").alias("v"))
    kind = lambda k: F.element_at(F.array(*[F.lit(x) for x in scoring.VERDICTS]), ((F.col("v") + k) % 4 + 1).cast("int"))
    row = lambda k, at: rows.select("eval_key", "universe", F.lit(at).cast("timestamp").alias("run_at"), kind(k).alias("verdict"), F.col("v"))
    return row(0, "2026-01-01").drop("v"), row(1, "2026-02-01").where("v % 3 = 0").drop("v").unionByName(row(2, "2025-12-01").where("v % 5 = 0").drop("v"))


@query(f"SELECT eval_key, universe, ['pass', 'partial', 'fail', 'insufficient_data'][CAST((v + CASE WHEN v % 3 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INTEGER)] AS verdict FROM ({_ROWS})")
def upsert_latest(p: Inputs) -> DataFrame:
    """The newest verdict of each key and universe; an older one that comes later changes nothing."""
    return sinks.upsert(*_verdict_rows(p), sinks.VERDICT_KEYS, "run_at").drop("run_at")


@query(f"SELECT eval_key, universe FROM ({_ROWS}) WHERE v % 3 <> 0")
def delete_rows(p: Inputs) -> DataFrame:
    existing, new = _verdict_rows(p)
    left, _ = sinks.delete(existing, new.where("run_at >= '2026-01-15'"), sinks.VERDICT_KEYS)
    return left.select("eval_key", "universe")


@query("""WITH rows AS (SELECT k AS eval_key, u AS universe, CASE WHEN k = 'low_volatility' THEN 'old' ELSE 'now' END AS sha FROM (SELECT unnest(['momentum_12_1', 'short_term_reversal', 'long_term_reversal', 'low_volatility', 'idiosyncratic_volatility']) AS k)
CROSS JOIN (SELECT unnest(['current', 'point_in_time']) AS u) UNION ALL SELECT 'unheard_of', 'current', 'now')
SELECT 'missing' AS problem, 'fifty_two_week_high' AS eval_key, u AS universe FROM (SELECT unnest(['current', 'point_in_time']) AS u)
UNION ALL SELECT 'unknown', eval_key, universe FROM rows WHERE eval_key = 'unheard_of' UNION ALL SELECT 'stale', eval_key, universe FROM rows WHERE sha = 'old'""")
def publish_check(p: Inputs) -> DataFrame:
    """What forbids publishing a store with a hole, a stray row and verdicts of an older registry."""
    keys = [a.key for a in scoring.ANOMALIES if a.key != "fifty_two_week_high"]
    rows = [(k, u, "old" if k == "low_volatility" else "now", 1, "fail") for k in keys for u in ("current", "point_in_time")] + [("unheard_of", "current", "now", 1, "fail")]
    stored = p.spark.createDataFrame(rows, "eval_key string, universe string, registry_sha string, rule_version int, verdict string")
    return scoring.snapshot_problems(stored, "now", ("current", "point_in_time"), scoring.registry(p.spark))


assert CTES.keys() == NEEDS.keys()
