"""Queries over single panels: scans, parsing, features, quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import features, quality
from tessera.plans.adapters import MARKET, Inputs, with_clause
from tessera.plans.catalogue import query
from tessera.sources import readers, sinks

R = 8


def rounded(df: DataFrame, *columns: str, places: int = R) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(with_clause("SELECT ticker, ts, close FROM bars WHERE ticker IN ('Brand#11', 'Brand#23', 'Brand#45') AND ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", ["bars"]))
def scan_filter_project(p: Inputs) -> DataFrame:
    return readers.load_prices(p.panel, tickers=["Brand#11", "Brand#23", "Brand#45"], start="1996-01-01", end="1997-12-31")


@query(with_clause("SELECT ticker, CAST(count(*) AS BIGINT) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM raw GROUP BY 1", ["raw"]))
def coverage(p: Inputs) -> DataFrame:
    return readers.coverage(p.raw)


@query(with_clause("SELECT CAST(count(*) AS BIGINT) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM raw WHERE ticker = 'Brand#23'", ["raw"]))
def count_bars(p: Inputs) -> DataFrame:
    return readers.count_bars(p.raw, "Brand#23")


RAW_TICKERS = (" brk-b ", "BRK.B", "RVTY (Previously PKI)", "American Airlines Group", "TOOLONGTICKER", "", "aapl", "BF-B (x)", "A.BC", "9XY")
_TICKER_SQL = """SELECT raw, CASE WHEN regexp_full_match(name, '[A-Z]{1,5}(\\.[A-Z])?') THEN name END AS ticker
FROM (SELECT raw, replace(trim(split_part(upper(trim(raw)), '(', 1)), '-', '.') AS name FROM (SELECT unnest([%s]) AS raw UNION ALL SELECT DISTINCT p_brand FROM part))"""


@query(_TICKER_SQL % ", ".join(f"'{t}'" for t in RAW_TICKERS))
def normalise_ticker(p: Inputs) -> DataFrame:
    raw = p.spark.createDataFrame([(t,) for t in RAW_TICKERS], "raw string").unionByName(p.table("part").select(F.col("p_brand").alias("raw")).distinct())
    return raw.select("raw", readers.normalise_ticker(F.col("raw")).alias("ticker"))


@query("""WITH rows AS (SELECT 'T' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS ticker, * FROM part JOIN lineitem ON l_partkey = p_partkey)
SELECT ticker, CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS open, l_extendedprice + 1 AS high, l_extendedprice - 1 AS low, l_extendedprice AS close,
       CAST(l_quantity AS BIGINT) AS volume, CAST(NULL AS DOUBLE) AS vwap, CAST(l_linenumber AS BIGINT) AS n_trades FROM rows""")
def bars_from_json(p: Inputs) -> DataFrame:
    """Bars written as a vendor's JSON documents, one per part and month, and parsed again."""
    lines = p.table("part").join(p.table("lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice")
    bar = F.struct(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t"), price.alias("o"), (price + 1).alias("h"), (price - 1).alias("l"), price.alias("c"), F.col("l_quantity").alias("v"), F.col("l_linenumber").cast("double").alias("n"))
    ticker = F.concat(F.lit("T"), F.char(65 + F.col("p_partkey") % 26))
    month = F.trunc("l_shipdate", "month").alias("month")  # bounds a document, however long a series is
    documents = lines.groupBy("p_partkey", ticker.alias("ticker"), month).agg(F.to_json(F.struct(F.collect_list(bar).alias("results"))).alias("body"))
    return readers.bars_from_json(documents)


@query("""WITH b AS (SELECT DISTINCT 'B' || chr(65 + coalesce(TRY_CAST(substr(p_brand, 7, 1) AS INTEGER), 24)) || chr(65 + coalesce(TRY_CAST(substr(p_brand, 8, 1) AS INTEGER), 24)) AS ticker FROM part)
SELECT ticker, 'brands' AS index_name, DATE '2001-01-05' AS as_of FROM b UNION ALL SELECT ticker, 'brands', DATE '2001-02-05' FROM b WHERE ticker >= 'BD' AND ticker <> 'BFF' """)
def snapshot_parse(p: Inputs) -> DataFrame:
    """CSV revisions to snapshots: a short one is left out, of two on a day the newest counts."""
    digit = lambda k: F.char(65 + F.coalesce(F.expr(f"try_cast(substring(p_brand, {k}, 1) as int)"), F.lit(24)))
    names = p.table("part").select(F.concat(F.lit("B"), digit(7), digit(8)).alias("s")).distinct()
    text = lambda d, seq, day: d.agg(F.concat_ws("\n", F.array_append(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.concat(x, F.lit(",\"Name, Inc\",Tools"))), F.lit("not a ticker,x,y"))).alias("t")).select(F.lit(day).cast("date").alias("as_of"), F.lit(seq).alias("seq"), F.concat(F.lit("Symbol,Security,GICS Sector\n"), F.col("t")).alias("csv_text"))
    some = names.where("s >= 'BD'")
    revisions = text(names, 1, "2001-01-05").unionByName(text(names.limit(2), 1, "2001-01-20"))
    revisions = revisions.unionByName(text(some, 1, "2001-02-05")).unionByName(text(some.where("s <> 'BFF'"), 2, "2001-02-05"))
    return readers.parse_snapshots(revisions, "brands", least=5)


HTML = ('<table><tr><td>NO</td></tr></table><table id="constituents"><tr><th>Symbol</th></tr>', "</table><table><tr><td>ZZZ</td></tr></table>")


@query("SELECT DISTINCT n_regionkey AS page, split_part(substr(n_name, 1, 5), ' ', 1) AS ticker FROM nation WHERE regexp_full_match(split_part(substr(n_name, 1, 5), ' ', 1), '[A-Z]{1,5}')")
def html_constituents(p: Inputs) -> DataFrame:
    """The constituent tables of a page per region, its nations twice; a page without such a table adds nothing."""
    name = F.split_part(F.substring("n_name", 1, 5), F.lit(" "), F.lit(1))
    cell = F.concat(F.lit("<tr><td><a href='/x'>"), name, F.lit(" </a></td><td>1</td></tr>"))
    rows = F.array_join(F.flatten(F.array(F.collect_list(cell), F.collect_list(cell))), "\n")
    pages = p.table("nation").groupBy(F.col("n_regionkey").alias("page")).agg(F.concat(F.lit(HTML[0]), rows, F.lit(HTML[1])).alias("html"))
    pages = pages.unionByName(p.table("region").select(F.col("r_regionkey").alias("page"), F.lit("<p>none</p>").alias("html")))
    return readers.constituents_html(pages).select("page", F.explode("symbols").alias("ticker"))


@query(with_clause("SELECT ticker, ts, close FROM bars", ["bars"]))
def insert_ignore(p: Inputs) -> DataFrame:
    """Two overlapping loads, the second with other values: the first write stays."""
    first, second = p.prices.where("ts < '1999-01-01'"), p.prices.where("ts >= '1998-01-01'")
    changed = second.withColumn("close", F.when(F.col("ts") < "1999-01-01", -1.0).otherwise(F.col("close")))
    return sinks.insert_ignore(first, changed.unionByName(changed), sinks.BAR_KEYS)


@query(with_clause("SELECT ticker, min(ts) AS from_date, max(ts) AS to_date FROM bars WHERE ticker >= 'Brand#3' GROUP BY 1", ["bars"]))
def not_ingested(p: Inputs) -> DataFrame:
    """Jobs that the log lacks."""
    jobs = p.bars.groupBy("ticker").agg(F.min("ts").alias("from_date"), F.max("ts").alias("to_date"))
    return sinks.not_ingested(jobs, jobs.where("ticker < 'Brand#3'"))


_R = "close / nullif(lag(close, {0}) OVER w, 0) - 1"


@query(with_clause(f"""SELECT ticker, ts, round({_R.format(1)}, 8) AS ret_1d, round({_R.format(5)}, 8) AS ret_5d, round({_R.format(21)}, 8) AS ret_21d, round(ln(close / lag(close) OVER w), 8) AS logret_1d
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)""", ["bars"]))  # fmt: skip
def simple_returns(p: Inputs) -> DataFrame:
    out = p.fresh
    for add in (features.returns(1), features.returns(5), features.returns(21), features.log_returns):
        out = out.transform(add)
    return rounded(out, "ret_1d", "ret_5d", "ret_21d", "logret_1d").drop("close")


def full(expression: str, over: str, n: int) -> str:
    """A rolling SQL aggregate that is null until its window is full of values."""
    w = f"OVER (PARTITION BY ticker ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({over}) {w} = {n} THEN {expression} {w} END"


_LOG = "SELECT *, ln(close / c1) AS x FROM lagged"


@query(with_clause(f"SELECT ticker, ts, round({full('stddev_samp(x)', 'x', 21)} * sqrt(252e0), 8) AS vol_21d, round({full('stddev_samp(x)', 'x', 63)} * sqrt(252e0), 8) AS vol_63d FROM ({_LOG})", ["lagged"]))
def rolling_vol(p: Inputs) -> DataFrame:
    out = p.fresh.transform(features.volatility(21)).transform(features.volatility(63))
    return rounded(out, "vol_21d", "vol_63d").select("ticker", "ts", "vol_21d", "vol_63d")


@query(with_clause("SELECT ticker, ts, round(c21 / nullif(c252, 0) - 1, 8) AS mom_12_1, round(c252 / nullif(c756, 0) - 1, 8) AS rev_36_12 FROM lagged", ["lagged"]))
def momentum_reversal(p: Inputs) -> DataFrame:
    out = p.fresh.transform(features.momentum_12_1).transform(features.reversal_36_12)
    return rounded(out, "mom_12_1", "rev_36_12").drop("close")


@query(with_clause(f"SELECT ticker, ts, round(close / {full('max(close)', 'close', 252)}, 8) AS pct_252d_high FROM bars", ["bars"]))
def pct_high(p: Inputs) -> DataFrame:
    return rounded(p.fresh.transform(features.share_of_high()), "pct_252d_high").drop("close")


_IVOL = f"""SELECT ticker, ts, CASE WHEN mm > 0 AND rr - rm / mm * rm >= 0 AND ticker <> 'MKT' THEN round(sqrt((rr - rm / mm * rm) / 62e0) * sqrt(252e0), 6) END AS ivol_63d FROM (
SELECT ticker, ts, {full('sum(x * x)', 'x * m', 63)} AS rr, {full('sum(x * m)', 'x * m', 63)} AS rm, {full('sum(m * m)', 'x * m', 63)} AS mm FROM (
SELECT a.ticker, a.ts, a.x, b.x AS m FROM logs a LEFT JOIN (SELECT ts, x FROM logs WHERE ticker = 'MKT') b USING (ts)))"""
LOGS = ({"logs": "SELECT ticker, ts, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY ts)) AS x FROM with_market"}, {"logs": ["with_market"]})


@query(with_clause(_IVOL, ["logs"], LOGS))
def idio_vol(p: Inputs) -> DataFrame:
    out = p.with_market.transform(features.idiosyncratic_volatility(63, MARKET))
    return rounded(out, "ivol_63d", places=6).drop("close")


@query(with_clause(f"""SELECT ticker, ts, round({full('avg(close)', 'close', 50)}, 8) AS sma_50d, round({full('avg(close)', 'close', 200)}, 9) AS sma_200d,
  round((sig - {full('avg(sig)', 'sig', 252)}) / nullif({full('stddev_samp(sig)', 'sig', 252)}, 0), 6) AS z_mom_12_1
FROM bars JOIN mom USING (ticker, ts)""", ["bars", "mom"]))  # fmt: skip
def sma_zscore(p: Inputs) -> DataFrame:
    out = p.fresh
    for add in (features.moving_average(50), features.moving_average(200), features.momentum_12_1, features.z_score("mom_12_1")):
        out = out.transform(add)
    # places at which means of six-digit prices have no ties
    out = rounded(rounded(rounded(out, "sma_50d"), "sma_200d", places=9), "z_mom_12_1", places=6)
    return out.select("ticker", "ts", "sma_50d", "sma_200d", "z_mom_12_1")


_STANDARD = {"ret_1d": 8, "ret_5d": 8, "ret_21d": 8, "logret_1d": 8, "vol_21d": 8, "vol_63d": 8, "mom_12_1": 8, "sma_50d": 8, "sma_200d": 9, "z_mom_12_1": 6}


@query(with_clause(f"""SELECT ticker, ts, {', '.join(f'round({c}, {n}) AS {c}' for c, n in _STANDARD.items())} FROM (
  SELECT ticker, ts, close / c1 - 1 AS ret_1d, close / c5 - 1 AS ret_5d, close / c21 - 1 AS ret_21d, x AS logret_1d, {full('stddev_samp(x)', 'x', 21)} * sqrt(252e0) AS vol_21d, {full('stddev_samp(x)', 'x', 63)} * sqrt(252e0) AS vol_63d,
  sig AS mom_12_1, {full('avg(close)', 'close', 50)} AS sma_50d, {full('avg(close)', 'close', 200)} AS sma_200d, (sig - {full('avg(sig)', 'sig', 252)}) / nullif({full('stddev_samp(sig)', 'sig', 252)}, 0) AS z_mom_12_1 FROM (
  SELECT l.*, lag(close, 5) OVER (PARTITION BY ticker ORDER BY ts) AS c5, ln(close / c1) AS x, c21 / c252 - 1 AS sig FROM lagged l))""", ["lagged"]))  # fmt: skip
def standard_features(p: Inputs) -> DataFrame:
    """The standard set of features, every value."""
    out = p.fresh.transform(features.standard)
    return out.select("ticker", "ts", *(F.round(c, n).alias(c) for c, n in _STANDARD.items()))


@query(with_clause("SELECT ticker, ts, round(fwd_ret, 8) AS fwd_ret FROM fwd", ["fwd"]))
def forward_returns(p: Inputs) -> DataFrame:
    return rounded(features.forward_returns(p.fresh), "fwd_ret")


@query("""WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS ts, avg(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)
SELECT ticker, ts, round(close / nullif(lag(close, 21) OVER w, 0) - 1, 6) AS ret_21d,
  CASE WHEN count(close) OVER f = 50 THEN round(avg(close) OVER f, 7) END AS sma_50d
FROM s WINDOW w AS (PARTITION BY ticker ORDER BY ts), f AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def wide_features(p: Inputs) -> DataFrame:
    """Features over many series at once."""
    out = p.suppliers.transform(features.returns(21)).transform(features.moving_average(50))
    return rounded(rounded(out, "ret_21d", places=6), "sma_50d", places=7).drop("close")


_NEXT = "SELECT ticker, ts, close, lead(ts) OVER w AS nt, lead(close) OVER w AS nc FROM {0} WINDOW w AS (PARTITION BY ticker ORDER BY ts)"


@query(with_clause(f"SELECT ticker, ts, CAST(nt - ts AS INTEGER) AS gap_days FROM ({_NEXT.format('raw')}) WHERE nt - ts > 10", ["raw"]))
def coverage_gaps(p: Inputs) -> DataFrame:
    return quality.coverage_gaps(p.raw)


@query(with_clause(f"SELECT ticker, ts, round(close, 6) AS close, round(nc, 6) AS next_close, round(nc / close, 6) AS ratio FROM ({_NEXT.format('raw')}) WHERE nc / close > 4 OR nc / close < 0.25", ["raw"]))
def level_shifts(p: Inputs) -> DataFrame:
    return rounded(quality.level_shifts(p.raw), "close", "next_close", "ratio", places=6)


def defects_sql(source: str) -> str:
    n = _NEXT.format(source)
    return f"SELECT ticker, ts, 'level_shift' AS reason, nc / close AS size FROM ({n}) WHERE nc / close > 4 OR nc / close < 0.25 UNION ALL SELECT ticker, ts, 'coverage_gap', CAST(nt - ts AS DOUBLE) FROM ({n}) WHERE nt - ts > 10"


_FLAG = "SELECT ticker, reason FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE reason WHEN 'level_shift' THEN 0 ELSE 1 END, size DESC, ts) AS k FROM ({0})) WHERE k = 1"


@query(with_clause(_FLAG.format(defects_sql("defective")), ["defective"]))
def flag_suspects(p: Inputs) -> DataFrame:
    return quality.flag_suspects(p.defective).select("ticker", "reason")


@query(with_clause(f"SELECT ticker, ts, close FROM defective WHERE ticker NOT IN (SELECT ticker FROM ({_FLAG.format(defects_sql('defective'))}))", ["defective"]))
def drop_suspects(p: Inputs) -> DataFrame:
    return quality.drop_suspects(p.defective)


FIRST = "SELECT ticker, ts AS last_kept, reason FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts, reason) AS k FROM ({0})) WHERE k = 1"


@query(with_clause(f"SELECT ticker, last_kept, reason, CAST(sum(CASE WHEN ts > last_kept THEN 1 ELSE 0 END) AS BIGINT) AS rows_dropped FROM ({FIRST.format(defects_sql('defective'))}) JOIN defective USING (ticker) GROUP BY ALL", ["defective"]))
def truncate_suspects(p: Inputs) -> DataFrame:
    return quality.truncate_suspects(p.defective)[1]


_LAST_KEPT = "min(CASE WHEN nc / close > 4 OR nc / close < 0.25 OR nt - ts > 10 THEN ts END) OVER (PARTITION BY ticker)"


@query(with_clause(f"SELECT ticker, ts, close FROM (SELECT *, {_LAST_KEPT} AS last_kept FROM ({_NEXT.format('defective')})) WHERE last_kept IS NULL OR ts <= last_kept", ["defective"]))
def gated_panel(p: Inputs) -> DataFrame:
    return quality.truncate_suspects(p.defective)[0]


_ENOUGH = """SELECT max(ts) FROM (SELECT ts, count(DISTINCT ticker) AS k FROM defective GROUP BY 1) WHERE k >= 0.5 * (SELECT median(k) FROM (SELECT count(DISTINCT ticker) AS k FROM defective GROUP BY ts))"""


@query(with_clause(f"SELECT ticker, ts, close FROM defective WHERE ts <= ({_ENOUGH})", ["defective"]))
def trimmed_panel(p: Inputs) -> DataFrame:
    """The panel without its ragged end."""
    return quality.trim_ragged_end(p.defective)[0]


@query(with_clause("""SELECT ts, n_tickers FROM (SELECT ts, CAST(count(DISTINCT ticker) AS BIGINT) AS n_tickers FROM defective GROUP BY 1) n
WHERE ts > (SELECT max(ts) FROM (SELECT ts, count(DISTINCT ticker) AS k FROM defective GROUP BY 1) WHERE k >= 0.5 * (SELECT median(k) FROM (SELECT count(DISTINCT ticker) AS k FROM defective GROUP BY ts)))""", ["defective"]))  # fmt: skip
def trim_ragged_end(p: Inputs) -> DataFrame:
    return quality.trim_ragged_end(p.defective)[1]
