"""Queries about who is in the universe when, and what survivorship is worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import engine, membership, metrics, portfolio, scoring
from tessera.plans.adapters import Inputs, strategy_ctes, summary_sql, with_clause
from tessera.plans.panels import FIRST, defects_sql, rounded
from tessera.plans.catalogue import query
from tessera.plans.strategies import B, SIX, momentum
from tessera.sources.shared import stored


@query(with_clause("SELECT DISTINCT ticker FROM snapshots WHERE as_of = (SELECT max(as_of) FROM snapshots WHERE as_of <= DATE '1998-06-15')", ["snapshots"]))
def members_as_of(p: Inputs) -> DataFrame:
    return membership.members_as_of(p.snapshots, "1998-06-15")


@query(with_clause("SELECT ts, ticker FROM member", ["member"]))
def membership_panel(p: Inputs) -> DataFrame:
    return membership.membership_panel(p.snapshots, p.days)


@query(with_clause("SELECT DISTINCT ticker FROM snapshots WHERE as_of >= DATE '1997-01-01' AND ticker NOT IN (SELECT ticker FROM snapshots WHERE as_of = (SELECT max(as_of) FROM snapshots))", ["snapshots"]))
def dropped_names(p: Inputs) -> DataFrame:
    return membership.dropped_names(p.snapshots, "1997-01-01")


@query(with_clause("""SELECT ticker, CAST(count(*) AS BIGINT) AS n_member_days, CAST(count(close) AS BIGINT) AS n_price_days, CAST(count(*) - count(close) AS BIGINT) AS missing_days
FROM member LEFT JOIN raw USING (ts, ticker) GROUP BY 1""", ["member", "raw"]))  # fmt: skip
def coverage_report(p: Inputs) -> DataFrame:
    return membership.coverage_report(membership.membership_panel(p.snapshots, p.days), p.raw)


_KINDS = """SELECT m.ticker, CASE WHEN lo IS NULL THEN 'none' WHEN ts < lo THEN 'leading' WHEN ts > hi THEN 'trailing' ELSE 'interior' END AS kind, CAST(count(*) AS BIGINT) AS days
FROM (SELECT * FROM member ANTI JOIN {0} USING (ts, ticker)) m LEFT JOIN (SELECT ticker, min(ts) AS lo, max(ts) AS hi FROM {0} GROUP BY 1) s USING (ticker) GROUP BY 1, 2"""


@query(with_clause(_KINDS.format("raw"), ["member", "raw"]))
def classify_missing(p: Inputs) -> DataFrame:
    return membership.classify_missing(membership.membership_panel(p.snapshots, p.days), p.raw)


_GATED = f"SELECT d.* FROM defective d LEFT JOIN ({FIRST.format(defects_sql('defective'))}) f USING (ticker) WHERE last_kept IS NULL OR ts <= last_kept"


@query(with_clause(f"""SELECT never_priced, holed, never_priced > 0 OR holed > 0 AS blocked FROM (
SELECT CAST(count(*) FILTER (WHERE kind = 'none' AND ticker NOT IN (SELECT ticker FROM ({FIRST.format(defects_sql('defective'))}))) AS BIGINT) AS never_priced,
       CAST(count(*) FILTER (WHERE kind = 'interior' AND days > 5) AS BIGINT) AS holed FROM ({_KINDS.format('gated')}))""", ["member", "gated"], ({"gated": _GATED}, {"gated": ["defective"]})))  # fmt: skip
def coverage_gate(p: Inputs) -> DataFrame:
    """Whether the members' prices, after the quality gate, allow a comparison of universes."""
    from tessera.operators import quality

    kept, report = quality.truncate_suspects(p.defective)
    missing = membership.classify_missing(membership.membership_panel(p.snapshots, p.days), kept)
    return membership.gate(missing, report)


MASKED = ({"masked": "SELECT ts, ticker, sig FROM mom JOIN member USING (ts, ticker)"}, {"masked": ["mom", "member"]})


@query(with_clause("SELECT ts, ticker, round(sig, 8) AS sig FROM masked", ["masked"], MASKED))
def mask_before_rank(p: Inputs) -> DataFrame:
    return rounded(membership.restrict(momentum(p), membership.membership_panel(p.snapshots, p.days)), "sig")


def _strategy(prefix: str, signal: str) -> tuple[dict, dict]:
    return strategy_ctes(signal, B, prefix=prefix)


_PIT, _NOW = _strategy("pit_", "masked"), _strategy("now_", "survivors")
BOTH = (
    MASKED[0] | _PIT[0] | _NOW[0] | {"survivors": "SELECT ts, ticker, sig FROM mom WHERE ticker IN (SELECT ticker FROM snapshots WHERE as_of = (SELECT max(as_of) FROM snapshots))"}
    | {f"{x}_six": summary_sql(f"(SELECT * FROM {x}_inv WHERE ts IN (SELECT ts FROM {y}_inv))") for x, y in (("now", "pit"), ("pit", "now"))},
    MASKED[1] | _PIT[1] | _NOW[1] | {"survivors": ["mom", "snapshots"], "now_six": ["now_inv", "pit_inv"], "pit_six": ["now_inv", "pit_inv"]},
)


@query(with_clause(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(CAST(a.{m} AS DOUBLE), 8) AS current, round(CAST(b.{m} AS DOUBLE), 8) AS pit, round(CAST(a.{m} - b.{m} AS DOUBLE), 8) AS gap FROM now_six a CROSS JOIN pit_six b" for m in (*SIX, "n_days")), ["now_six", "pit_six"], BOTH))
def survivorship_gap(p: Inputs) -> DataFrame:
    """Today's members all along, against the members of each day, over the days that both are invested."""
    latest = p.snapshots.join(p.snapshots.agg(F.max("as_of").alias("as_of")), "as_of", "left_semi")
    now = momentum(p).join(latest.select("ticker"), "ticker", "left_semi").withColumn("universe", F.lit("current"))
    pit = membership.restrict(momentum(p), membership.membership_panel(p.snapshots, p.days)).withColumn("universe", F.lit("pit"))
    by = ["universe"]  # both in one plan
    weights = stored(engine.signal_weights(now.unionByName(pit), p.days, B, by=by), "weights")
    b = engine.run_backtest(p.prices, weights, by=by, forward=p.frame.select("ts", "ticker", "fwd_ret"))
    common = weights.groupBy("ts").agg(F.count_distinct("universe").alias("n")).where("n = 2")
    found = stored(metrics.summary(b.returns.join(common, "ts", "left_semi"), by=by), "summaries")  # two rows
    return rounded(scoring.survivorship_gap(*(found.where(F.col("universe") == u) for u in ("current", "pit"))), "current", "pit", "gap")


@query(with_clause("SELECT prev, as_of, CAST(as_of - prev AS INTEGER) AS gap_days FROM (SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS prev FROM (SELECT DISTINCT as_of FROM snapshots)) WHERE prev IS NOT NULL", ["snapshots"]))
def snapshot_spacing(p: Inputs) -> DataFrame:
    return membership.spacing(p.snapshots)


_SPELLS = """SELECT ticker, first_seen, last_seen, n_snapshots, CASE WHEN first_seen > lo AND last_seen < hi THEN 'both' WHEN first_seen > lo THEN 'joined_late' WHEN last_seen < hi THEN 'removed' ELSE 'always' END AS change
FROM (SELECT ticker, min(as_of) AS first_seen, max(as_of) AS last_seen, CAST(count(DISTINCT as_of) AS BIGINT) AS n_snapshots FROM snapshots GROUP BY 1) CROSS JOIN (SELECT min(as_of) AS lo, max(as_of) AS hi FROM snapshots)"""


_GAPS = "SELECT prev, as_of, CAST(as_of - prev AS INTEGER) AS gap_days FROM (SELECT as_of, lag(as_of) OVER (ORDER BY as_of) AS prev FROM (SELECT DISTINCT as_of FROM snapshots)) WHERE prev IS NOT NULL"


@query(with_clause(f"SELECT *, as_of > (SELECT min(ts) FROM days) AND prev < (SELECT max(ts) FROM days) AS inside FROM ({_GAPS}) WHERE gap_days > 90", ["snapshots", "days"]))
def long_gaps(p: Inputs) -> DataFrame:
    """Quarterly snapshots lie 90 days apart or more."""
    return membership.long_gaps(p.snapshots, p.days, 90)


@query(with_clause(f"""SELECT (SELECT CAST(count(DISTINCT as_of) AS BIGINT) FROM snapshots) AS n_snapshots, median(gap_days) AS median_days, max(gap_days) AS worst_days FROM ({_GAPS})""", ["snapshots"]))
def snapshot_resolution(p: Inputs) -> DataFrame:
    return membership.resolution(p.snapshots, p.days)


@query(with_clause("""SELECT n AS n_member_days, CAST(count(*) AS BIGINT) AS n_names, min(e) AS ends, CASE WHEN min(e) = (SELECT max(ts) FROM member) THEN 'joined late' ELSE 'removed' END AS kind
FROM (SELECT ticker, CAST(count(*) AS BIGINT) AS n, max(ts) AS e FROM member GROUP BY 1) WHERE n < (SELECT count(DISTINCT ts) FROM member) GROUP BY n HAVING min(e) = max(e)""", ["member"]))
def day_clusters(p: Inputs) -> DataFrame:
    return membership.day_clusters(membership.membership_panel(p.snapshots, p.days))


@query(with_clause(_SPELLS, ["snapshots"]))
def membership_spells(p: Inputs) -> DataFrame:
    return membership.spells(p.snapshots)


@query(with_clause(f"""SELECT last_seen, n_names, gap_days FROM (SELECT last_seen, CAST(count(*) AS BIGINT) AS n_names FROM ({_SPELLS}) WHERE change IN ('removed', 'both') GROUP BY 1)
LEFT JOIN (SELECT as_of AS last_seen, CAST(lead(as_of) OVER (ORDER BY as_of) - as_of AS INTEGER) AS gap_days FROM (SELECT DISTINCT as_of FROM snapshots)) USING (last_seen)""", ["snapshots"]))  # fmt: skip
def removal_clusters(p: Inputs) -> DataFrame:
    return membership.removal_clusters(p.snapshots)


@query(with_clause("""SELECT min(n) AS min_days, median(n) AS median_days, max(n) AS max_days, CAST(count(DISTINCT n) AS BIGINT) AS n_distinct, CAST(count(*) AS BIGINT) AS n_names
FROM (SELECT ticker, CAST(count(*) AS BIGINT) AS n FROM member GROUP BY 1)""", ["member"]))  # fmt: skip
def member_days(p: Inputs) -> DataFrame:
    return membership.member_days(membership.membership_panel(p.snapshots, p.days))


@query(with_clause("SELECT ts, ticker, w FROM pit_w", ["pit_w"], BOTH))
def masked_weights(p: Inputs) -> DataFrame:
    """Weights of the members of each month end."""
    signal = membership.restrict(momentum(p), membership.membership_panel(p.snapshots, p.days)).where("sig is not null")
    return portfolio.decile_weights(signal.join(portfolio.month_ends(signal.select("ts").distinct()), "ts", "left_semi"), B)
