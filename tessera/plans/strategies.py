"""Queries from a signal to returns, and what those rest on. The main signal is 12-1 momentum in five buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import diagnostics, engine, features, metrics, portfolio, stats, walkforward
from tessera.operators.engine import Backtest
from tessera.plans.adapters import Inputs, strategy_ctes, summary_sql, with_clause
from tessera.plans.panels import rounded
from tessera.plans.catalogue import query
from tessera.sources.shared import stored

B = 5
MOM = strategy_ctes("mom", B)


def momentum(p: Inputs) -> DataFrame:
    return p.frame.select("ts", "ticker", "sig")


def backtest(p: Inputs, n_buckets: int = B, long_short: bool = True, cost_bps: float = 10.0) -> Backtest:
    """All steps read one frame of prices, forward returns and signals, whose columns come from one pass over the series."""
    weights = stored(engine.signal_weights(momentum(p), p.days, n_buckets, long_short), "weights")  # read by each step of the accounting
    return engine.run_backtest(p.prices, weights, cost_bps, forward=p.frame.select("ts", "ticker", "fwd_ret"))


def held_returns(p: Inputs) -> DataFrame:
    b = backtest(p)
    return engine.invested(b.returns, b.weights)


def month_end_signal(p: Inputs) -> DataFrame:
    signal = momentum(p).where("sig is not null")
    return signal.join(portfolio.month_ends(signal.select("ts").distinct()), "ts", "left_semi")


def mom_sql(query_text: str, *names: str) -> str:
    return with_clause(query_text, list(names), MOM)


@query(with_clause("SELECT max(ts) AS ts FROM days GROUP BY date_trunc('month', ts)", ["days"]))
def month_ends(p: Inputs) -> DataFrame:
    return portfolio.month_ends(p.days)


@query(mom_sql("SELECT ts, ticker, w FROM w", "w"))
def decile_weights(p: Inputs) -> DataFrame:
    return portfolio.decile_weights(month_end_signal(p), B)


_LONG = strategy_ctes("mom", 10, long_short=False)


@query(with_clause("SELECT ts, ticker, w FROM w", ["w"], _LONG))
def decile_weights_long_only(p: Inputs) -> DataFrame:
    return portfolio.decile_weights(month_end_signal(p), 10, long_short=False)


@query(mom_sql("SELECT ts, ticker, w FROM held", "held"))
def hold_weights(p: Inputs) -> DataFrame:
    return portfolio.hold(portfolio.decile_weights(month_end_signal(p), B), p.days)


@query(mom_sql("SELECT ts, round(turnover, 8) AS turnover FROM turn", "turn"))
def turnover(p: Inputs) -> DataFrame:
    return rounded(backtest(p).turnover, "turnover")


@query(mom_sql("SELECT ts, round(gross_ret, 8) AS gross_ret, round(cost, 8) AS cost, round(ret, 8) AS ret FROM ret", "ret"))
def backtest_returns(p: Inputs) -> DataFrame:
    return rounded(backtest(p).returns, "gross_ret", "cost", "ret")


@query(mom_sql("SELECT ts, round(ret, 8) AS ret FROM inv", "inv"))
def invested_returns(p: Inputs) -> DataFrame:
    return rounded(held_returns(p).select("ts", "ret"), "ret")


SIX = ("total_return", "cagr", "ann_vol", "sharpe", "max_drawdown")


def six_sql(inner: str) -> str:
    return f"SELECT {', '.join(f'round({c}, 8) AS {c}' for c in SIX)}, n_days FROM ({inner})"


@query(mom_sql(six_sql(summary_sql("inv")), "inv"))
def backtest_summary(p: Inputs) -> DataFrame:
    return rounded(metrics.summary(held_returns(p)), *SIX)


_HOLD_MKT = """SELECT ts, next_close / close - 1 AS ret FROM (SELECT ts, close, lead(close) OVER (ORDER BY ts) AS next_close FROM market) WHERE ts IN (SELECT ts FROM inv)"""


@query(mom_sql(six_sql(summary_sql(f"({_HOLD_MKT})")), "inv", "market"))
def buy_and_hold(p: Inputs) -> DataFrame:
    """The market over the strategy's invested days, at no cost."""
    b = backtest(p)
    weights = portfolio.fixed_weights(b.weights.select("ts").distinct(), "MKT")
    market = engine.run_backtest(p.market, weights, cost_bps=0.0)
    return rounded(metrics.summary(engine.invested(market.returns, b.weights)), *SIX)


_EQUITY = "SELECT ts, equity, equity / greatest(1e0, max(equity) OVER (ORDER BY ts)) - 1 AS drawdown FROM (SELECT ts, product(1 + ret) OVER (ORDER BY ts) AS equity FROM inv)"


@query(mom_sql(f"SELECT ts, round(equity, 8) AS equity, round(drawdown, 8) AS drawdown FROM ({_EQUITY})", "inv"))
def equity_drawdown(p: Inputs) -> DataFrame:
    return rounded(metrics.equity(held_returns(p)).select("ts", "equity", "drawdown"), "equity", "drawdown")


@query(mom_sql(f"""SELECT 0 AS i, min(ts) AS ts, 1e0 AS equity FROM inv UNION ALL SELECT CAST(i AS INTEGER), ts, round(equity, 5) FROM (
SELECT *, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM ({_EQUITY})) WHERE (i - 1) % CAST(ceil(n / 160.0) AS BIGINT) = 0 OR i = n""", "inv"))  # fmt: skip
def equity_curve(p: Inputs) -> DataFrame:
    return diagnostics.equity_curve(held_returns(p))


_BUCKETS = f"""SELECT bucket, avg(r) * 252 AS ann_return, CAST(count(*) AS BIGINT) AS n_days FROM (
  SELECT m.ts, bucket, avg(fwd_ret) AS r FROM (SELECT DISTINCT ts FROM held) h JOIN map m USING (ts) JOIN (
    SELECT ts AS reb, ticker, CAST((rk - 1) * {B} // n + 1 AS INTEGER) AS bucket FROM (
      SELECT ts, ticker, row_number() OVER (PARTITION BY ts ORDER BY sig, ticker) AS rk, count(*) OVER (PARTITION BY ts) AS n FROM mom WHERE sig IS NOT NULL AND ts IN (SELECT ts FROM ends)) WHERE n >= {B}
  ) b USING (reb) JOIN fwd f ON f.ts = m.ts AND f.ticker = b.ticker GROUP BY 1, 2) WHERE r IS NOT NULL GROUP BY 1"""


def _buckets(p: Inputs) -> DataFrame:
    signal = momentum(p)
    ends = portfolio.month_ends(signal.where("sig is not null").select("ts").distinct())
    return diagnostics.bucket_returns(p.prices, signal, ends, backtest(p).weights, B, forward=p.frame.select("ts", "ticker", "fwd_ret"))


@query(mom_sql(f"SELECT bucket, round(ann_return, 8) AS ann_return, n_days FROM ({_BUCKETS})", "held", "map", "fwd", "ends"))
def bucket_returns(p: Inputs) -> DataFrame:
    return rounded(_buckets(p), "ann_return")


_MEAN_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0"


@query(mom_sql(f"SELECT CASE WHEN count(*) >= 3 THEN round(corr(x, y), 8) END AS rho FROM (SELECT {_MEAN_RANK.format('bucket')} AS x, {_MEAN_RANK.format('ann_return')} AS y FROM ({_BUCKETS}))", "held", "map", "fwd", "ends"))
def monotonicity(p: Inputs) -> DataFrame:
    return rounded(diagnostics.monotonicity(_buckets(p)), "rho")


_SHARPE = "avg({0}) / nullif(stddev_samp({0}), 0) * sqrt(252e0)"


@query(mom_sql(f"""SELECT half, min(ts) AS first_date, max(ts) AS last_date, round({_SHARPE.format('ret')}, 8) AS sharpe, CAST(count(*) AS BIGINT) AS n_days FROM (
SELECT *, CASE WHEN row_number() OVER (ORDER BY ts) <= count(*) OVER () // 2 THEN 1 ELSE 2 END AS half FROM inv) GROUP BY half""", "inv"))  # fmt: skip
def halves(p: Inputs) -> DataFrame:
    return rounded(diagnostics.halves(held_returns(p)), "sharpe")


@query(mom_sql(f"""SELECT c AS cost_bps, round({_SHARPE.format('r')}, 8) AS sharpe, round(pow(product(1 + r), 252e0 / count(*)) - 1, 8) AS cagr FROM (
SELECT c, gross_ret - coalesce(turnover, 0e0) * c / 1e4 AS r FROM inv LEFT JOIN turn USING (ts) CROSS JOIN (SELECT unnest([0, 10, 25]) AS c)) GROUP BY c""", "inv", "turn"))  # fmt: skip
def cost_grid(p: Inputs) -> DataFrame:
    b = backtest(p)
    return rounded(diagnostics.cost_grid(engine.invested(b.returns, b.weights), b.turnover), "sharpe", "cagr")


@query(mom_sql(f"SELECT CAST(date_trunc('month', ts) AS DATE) AS month, round(arg_max(equity, ts), 8) AS equity FROM ({_EQUITY}) GROUP BY 1", "inv"))
def monthly_curve(p: Inputs) -> DataFrame:
    return rounded(diagnostics.monthly_curve(held_returns(p)), "equity")


@query(with_clause("SELECT CAST(row_number() OVER (ORDER BY abs(fwd_ret) DESC, ts, ticker) AS INTEGER) AS rank, ts, ticker, round(fwd_ret, 8) AS fwd_ret FROM fwd WHERE fwd_ret IS NOT NULL QUALIFY rank <= 5", ["fwd"]))
def top_moves(p: Inputs) -> DataFrame:
    return rounded(diagnostics.top_moves(p.prices), "fwd_ret")


@query("""WITH lp AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS ts, avg(l_extendedprice) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT CAST(count(*) AS BIGINT) AS n_large FROM (SELECT lead(close) OVER (PARTITION BY ticker ORDER BY ts) / close - 1 AS r FROM lp) WHERE abs(r) > 0.4""")
def large_moves(p: Inputs) -> DataFrame:
    return diagnostics.large_moves(p.raw)


_CONTRIB = "SELECT ts, ticker, w, fwd_ret, w * fwd_ret AS contrib FROM held JOIN fwd USING (ts, ticker) WHERE fwd_ret IS NOT NULL"


@query(mom_sql(f"""SELECT day_rank, ts, round(ret, 8) AS ret, name_rank, ticker, round(contrib, 8) AS contrib FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY ts ORDER BY abs(contrib) DESC, ticker) AS INTEGER) AS name_rank FROM ({_CONTRIB}) JOIN (
SELECT ts, ret, CAST(row_number() OVER (ORDER BY abs(ret) DESC, ts) AS INTEGER) AS day_rank FROM inv QUALIFY day_rank <= 8) USING (ts)) WHERE name_rank <= 3""", "held", "fwd", "inv"))  # fmt: skip
def top_days_drivers(p: Inputs) -> DataFrame:
    b = backtest(p)
    out = diagnostics.top_days_drivers(diagnostics.contributions(p.prices, b.weights), engine.invested(b.returns, b.weights))
    return rounded(out, "ret", "contrib")


@query(mom_sql(f"SELECT ticker, CAST(count(*) AS BIGINT) AS days_held, round(sum(contrib), 8) AS total FROM ({_CONTRIB}) GROUP BY 1", "held", "fwd"))
def name_totals(p: Inputs) -> DataFrame:
    return rounded(diagnostics.name_totals(diagnostics.contributions(p.prices, backtest(p).weights)), "total")


@query(mom_sql("""SELECT k, round(product(CASE WHEN up > k THEN 1 + ret ELSE 1e0 END) - 1, 8) AS ex_best, round(product(CASE WHEN down > k THEN 1 + ret ELSE 1e0 END) - 1, 8) AS ex_worst FROM (
SELECT ret, row_number() OVER (ORDER BY ret DESC, ts) AS up, row_number() OVER (ORDER BY ret, ts) AS down FROM inv) CROSS JOIN (SELECT unnest([1, 5, 10]) AS k) GROUP BY k""", "inv"))  # fmt: skip
def concentration(p: Inputs) -> DataFrame:
    return rounded(diagnostics.concentration(held_returns(p)), "ex_best", "ex_worst")


@query(mom_sql("SELECT round(sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) / count(*), 8) AS up_share, CAST(count(*) AS BIGINT) AS n_days FROM inv", "inv"))
def up_days(p: Inputs) -> DataFrame:
    return rounded(diagnostics.up_days(held_returns(p)), "up_share")


@query(mom_sql("""SELECT round(a, 8) AS indep_ann, round(b, 8) AS actual_ann, round(b / nullif(a, 0), 6) AS ratio FROM (
SELECT avg(v) * sqrt(252e0) AS a FROM (SELECT ts, sqrt(sum(pow(w * sd, 2))) AS v FROM held JOIN (SELECT ticker, stddev_samp(fwd_ret) AS sd FROM fwd GROUP BY 1) USING (ticker) GROUP BY ts))
CROSS JOIN (SELECT stddev_samp(ret) * sqrt(252e0) AS b FROM inv)""", "held", "fwd", "inv"))  # fmt: skip
def diversification(p: Inputs) -> DataFrame:
    b = backtest(p)
    out = diagnostics.diversification(p.prices, b.weights, engine.invested(b.returns, b.weights))
    return rounded(rounded(out, "indep_ann", "actual_ann"), "ratio", places=6)


@query(mom_sql("""SELECT ts, ticker, round(fwd_ret, 8) AS fwd_ret, round(prev_ret, 8) AS prev_ret, coalesce(w, 0e0) AS w FROM (
SELECT ts, ticker, fwd_ret, lag(fwd_ret) OVER (PARTITION BY ticker ORDER BY ts) AS prev_ret FROM fwd) LEFT JOIN held USING (ts, ticker) WHERE abs(fwd_ret) > 0.006""", "held", "fwd"))  # fmt: skip
def suspect_rows(p: Inputs) -> DataFrame:
    """Large moves beside the weights held; the limit suits this smooth panel."""
    return rounded(diagnostics.suspect_rows(p.prices, backtest(p).weights, 0.006), "fwd_ret", "prev_ret")


def moments_sql(source: str, column: str = "ret") -> str:
    return f"""SELECT m / nullif(sd, 0) AS sr, m3 / pow(m2, 1.5e0) AS skew, m4 / (m2 * m2) AS kurt, n FROM (
      SELECT any_value(m) AS m, any_value(sd) AS sd, CAST(count(*) AS BIGINT) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4
      FROM (SELECT {column} AS x, avg({column}) OVER () AS m, stddev_samp({column}) OVER () AS sd FROM {source}))"""


@query(mom_sql(f"SELECT round(sr, 8) AS sr, round(skew, 6) AS skew, round(kurt, 6) AS kurt, n FROM ({moments_sql('inv')})", "inv"))
def sharpe_moments(p: Inputs) -> DataFrame:
    return rounded(rounded(stats.moments(held_returns(p)), "sr"), "skew", "kurt", places=6)


N_SPLITS, MIN_TRAIN, EMBARGO = 5, 504, 21
TRAIN, TEST = 504, 126
_NUMBERED = "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM days"
EXPANDING = f"""SELECT CAST(split AS INTEGER) AS split, (SELECT min(ts) FROM days) AS train_start, b.ts AS train_end, c.ts AS test_start, d.ts AS test_end FROM (
  SELECT split, min(i) AS lo, max(i) AS hi FROM (SELECT i, least({N_SPLITS - 1}, (i - {MIN_TRAIN}) // (((SELECT count(*) FROM days) - {MIN_TRAIN}) // {N_SPLITS})) AS split FROM ({_NUMBERED}) WHERE i >= {MIN_TRAIN}) GROUP BY split) s
  JOIN ({_NUMBERED}) b ON b.i = lo - 1 - {EMBARGO} JOIN ({_NUMBERED}) c ON c.i = lo JOIN ({_NUMBERED}) d ON d.i = hi"""


@query(with_clause(EXPANDING, ["days"]))
def walkforward_expanding(p: Inputs) -> DataFrame:
    return walkforward.validate_splits(walkforward.expanding_splits(p.days, N_SPLITS, MIN_TRAIN, EMBARGO))


@query(with_clause(f"""SELECT CAST(s AS INTEGER) AS split, a.ts AS train_start, b.ts AS train_end, c.ts AS test_start, d.ts AS test_end
FROM (SELECT unnest(range(0, ((SELECT count(*) FROM days) - {TRAIN} - {EMBARGO} - {TEST}) // {TEST} + 1)) AS s)
JOIN ({_NUMBERED}) a ON a.i = s * {TEST} JOIN ({_NUMBERED}) b ON b.i = s * {TEST} + {TRAIN - 1} JOIN ({_NUMBERED}) c ON c.i = s * {TEST} + {TRAIN + EMBARGO} JOIN ({_NUMBERED}) d ON d.i = s * {TEST} + {TRAIN + EMBARGO + TEST - 1}""", ["days"]))  # fmt: skip
def walkforward_rolling(p: Inputs) -> DataFrame:
    return walkforward.validate_splits(walkforward.rolling_splits(p.days, TRAIN, TEST, embargo=EMBARGO))


@query(mom_sql(f"SELECT ts, round(ret, 8) AS ret, split FROM ret JOIN ({EXPANDING}) ON ts BETWEEN test_start AND test_end", "ret", "days"))
def oos_returns(p: Inputs) -> DataFrame:
    """The strategy's returns in the test windows, tagged with their split."""
    splits = walkforward.expanding_splits(p.days, N_SPLITS, MIN_TRAIN, EMBARGO)
    return rounded(walkforward.stitch(splits, backtest(p).returns), "ret")


@query("""WITH l AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS ts, min(o_orderkey) AS id FROM orders GROUP BY 1, 2), r AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS ts, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT l.k, l.ts, l.id, r.price FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts""")
def asof_by_key(p: Inputs) -> DataFrame:
    """Each customer's order days with the price of the latest finished order up to the day."""
    from tessera.functions.windows import asof_by_key as asof

    orders = p.table("orders").withColumn("ts", F.to_date("o_orderdate")).withColumnRenamed("o_custkey", "k")
    left = orders.groupBy("k", "ts").agg(F.min("o_orderkey").alias("id"))
    right = orders.where("o_orderstatus = 'F'").groupBy("k", "ts").agg(F.max("o_totalprice").alias("price"))
    return asof(left, right, "price", key="k")
