"""Panels derived from the star-schema tables: a dense one, an irregular one, a wide one, memberships, defects."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import features
from tessera.sources.shared import steady, stored

#: Quarterly members: the brands with the largest volume.
MEMBERS = 20
MARKET = "MKT"
#: Planted defects: a brand whose level jumps tenfold, one with a hole, and how many brands reach the last days.
SPLICED, HOLED, RAGGED_DAYS, REACHING = "Brand#12", "Brand#23", 5, 3
SPLICE_FROM, HOLE_FROM, HOLE_TO = "1998-03-02", "1999-05-03", "1999-06-01"


class Inputs:
    """The tables of a folder and the panels over them, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = steady(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def brand_days(self) -> DataFrame:
        """(ticker, ts, d, volume, price) per brand and ship date. The aggregation by part comes before the join, which then moves few rows."""
        lines = self.table("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("ts"), "l_discount", "l_quantity", "l_extendedprice")
        brands = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
        rows = lines.join(brands, "l_partkey").groupBy("ticker", "ts")
        return rows.agg(F.avg("l_discount").alias("d"), F.sum("l_quantity").alias("volume"), F.avg("l_extendedprice").alias("price"))

    @cached_property
    def panel(self) -> DataFrame:
        """(ticker, ts, close, r, volume): every brand on every ship date, prices compounded from the mean discount."""
        seen = self.brand_days
        # dates times brands: the panel itself, which is dense by definition; the dates are one row, an array of one entry a day
        days = seen.agg(F.collect_set("ts").alias("days"))
        grid = seen.select("ticker").distinct().crossJoin(F.broadcast(days)).select("ticker", F.explode("days").alias("ts"))
        rows = grid.join(seen, ["ticker", "ts"], "left")
        rows = rows.select("ticker", "ts", F.round(F.coalesce((F.col("d") - 0.05) / 5, F.lit(0.0)), 8).alias("r"), F.coalesce("volume", F.lit(0.0)).alias("volume"))
        run = Window.partitionBy("ticker").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("ticker", "ts", F.round(100 * F.exp(F.sum("r").over(run)), 6).alias("close"), "r", "volume")

    @cached_property
    def fresh(self) -> DataFrame:
        """The panel's prices, for queries that read them once."""
        return self.panel.select("ticker", "ts", "close")

    @cached_property
    def frame(self) -> DataFrame:
        """The panel for queries whose every step reads it: written once, which also keeps plans small.

        Beside prices, returns and volume it holds what the main strategy needs of each row, from the same window:
        fwd_ret and sig, the 12-1 momentum.
        """
        rows = self.panel.transform(features.momentum_12_1).withColumnRenamed("mom_12_1", "sig")
        return stored(rows.withColumn("fwd_ret", features.forward()), "frame")

    @cached_property
    def bars(self) -> DataFrame:
        return self.frame.select("ticker", "ts", "close", "r", "volume")

    @cached_property
    def prices(self) -> DataFrame:
        return self.bars.select("ticker", "ts", "close")

    @cached_property
    def market(self) -> DataFrame:
        """The equal-weight market in the same form, one series."""
        daily = self.bars.groupBy("ts").agg(F.avg("r").alias("r"))
        run = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
        return daily.select(F.lit(MARKET).alias("ticker"), "ts", F.round(100 * F.exp(F.sum("r").over(run)), 6).alias("close"))

    @cached_property
    def with_market(self) -> DataFrame:
        return self.prices.unionByName(self.market)

    @cached_property
    def raw(self) -> DataFrame:
        """(ticker, ts, close): the mean price on days with a sale, as irregular as it is."""
        return self.brand_days.select("ticker", "ts", F.col("price").alias("close"))

    @cached_property
    def suppliers(self) -> DataFrame:
        """The wide panel: one series per supplier."""
        rows = self.table("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("ts"))
        return rows.agg(F.avg("l_extendedprice").alias("close"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """(ticker, index_name, as_of): each quarter's largest brands, known from the next quarter on."""
        quarter = F.trunc("ts", "quarter")
        volume = self.bars.groupBy("ticker", quarter.alias("q")).agg(F.sum("volume").alias("v"))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("v"), "ticker"))
        rows = volume.withColumn("rk", rank).where(F.col("rk") <= MEMBERS)
        rows = rows.select("ticker", F.lit("brands").alias("index_name"), F.add_months("q", 3).alias("as_of"))
        last = self.bars.agg(F.max("ts").alias("_last"))
        return stored(rows.crossJoin(F.broadcast(last)).where("as_of <= _last").drop("_last"), "snapshots")

    @cached_property
    def defective(self) -> DataFrame:
        """The dense panel with planted defects: a splice, a hole, a ragged end."""
        days = self.bars.select("ts").distinct().orderBy(F.desc("ts")).limit(RAGGED_DAYS).agg(F.min("ts").alias("_tail"))
        reach = self.bars.select("ticker").distinct().orderBy("ticker").limit(REACHING).withColumn("_reach", F.lit(True))
        rows = self.prices.crossJoin(F.broadcast(days)).join(F.broadcast(reach), "ticker", "left")
        hole = (F.col("ticker") == HOLED) & F.col("ts").between(HOLE_FROM, HOLE_TO)
        cut = (F.col("ts") >= F.col("_tail")) & F.col("_reach").isNull()
        close = F.when((F.col("ticker") == SPLICED) & (F.col("ts") >= SPLICE_FROM), F.col("close") * 10).otherwise(F.col("close"))
        return rows.where(~hole & ~cut).select("ticker", "ts", close.alias("close"))

    @cached_property
    def days(self) -> DataFrame:
        return self.bars.select("ts").distinct()

    @cached_property
    def runs(self) -> DataFrame:
        """events as live runs: (run_id, created_at, visitor, cost, status)."""
        return self.table("events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.col("user_id").alias("visitor"), (F.col("value") / 100).alias("cost"), F.col("event_type").alias("status"))


#: The same panels in DuckDB's SQL: name, and the query that a WITH clause gives it.
CTES = {
    "lp": """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS ts, avg(l_discount) AS d, sum(l_quantity) AS volume, avg(l_extendedprice) AS price
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "grid": "SELECT ticker, ts FROM (SELECT DISTINCT ticker FROM lp) CROSS JOIN (SELECT DISTINCT ts FROM lp)",
    "rets": "SELECT g.ticker, g.ts, round(coalesce((lp.d - 0.05e0) / 5e0, 0e0), 8) AS r, coalesce(volume, 0e0) AS volume FROM grid g LEFT JOIN lp USING (ticker, ts)",
    "bars": "SELECT ticker, ts, round(100e0 * exp(sum(r) OVER (PARTITION BY ticker ORDER BY ts)), 6) AS close, r, volume FROM rets",
    "days": "SELECT DISTINCT ts FROM bars",
    "market": """SELECT 'MKT' AS ticker, ts, round(100e0 * exp(sum(r) OVER (ORDER BY ts)), 6) AS close
                 FROM (SELECT ts, avg(r) AS r FROM bars GROUP BY ts)""",
    "with_market": "SELECT ticker, ts, close FROM bars UNION ALL SELECT ticker, ts, close FROM market",
    "raw": "SELECT ticker, ts, price AS close FROM lp",
    "suppliers": "SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS ts, avg(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2",
    "quarters": "SELECT ticker, CAST(date_trunc('quarter', ts) AS DATE) AS q, sum(volume) AS v FROM bars GROUP BY 1, 2",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY q ORDER BY v DESC, ticker) AS rk FROM quarters",
    "snapshots": f"""SELECT ticker, 'brands' AS index_name, CAST(q + INTERVAL 3 MONTH AS DATE) AS as_of FROM ranked
                     WHERE rk <= {MEMBERS} AND q + INTERVAL 3 MONTH <= (SELECT max(ts) FROM bars)""",
    "defective": f"""SELECT ticker, ts, CASE WHEN ticker = '{SPLICED}' AND ts >= DATE '{SPLICE_FROM}' THEN close * 10e0 ELSE close END AS close FROM bars
                     WHERE NOT (ticker = '{HOLED}' AND ts BETWEEN DATE '{HOLE_FROM}' AND DATE '{HOLE_TO}')
                       AND NOT (ts >= (SELECT min(ts) FROM (SELECT ts FROM days ORDER BY ts DESC LIMIT {RAGGED_DAYS}))
                                AND ticker NOT IN (SELECT DISTINCT ticker FROM bars ORDER BY ticker LIMIT {REACHING}))""",
    "member": "SELECT d.ts, s.ticker FROM days d JOIN snapshots s ON s.as_of = (SELECT max(x.as_of) FROM snapshots x WHERE x.as_of <= d.ts)",
    "lagged": """SELECT *, lag(close, 21) OVER w AS c21, lag(close, 252) OVER w AS c252, lag(close, 756) OVER w AS c756, lead(close) OVER w AS next_close,
                 lag(close) OVER w AS c1 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)""",
    "mom": "SELECT ticker, ts, c21 / nullif(c252, 0) - 1 AS sig FROM lagged",
    "fwd": "SELECT ticker, ts, next_close / nullif(close, 0) - 1 AS fwd_ret FROM lagged",
}
NEEDS = {
    "lp": [], "grid": ["lp"], "rets": ["grid", "lp"], "bars": ["rets"], "days": ["bars"], "market": ["bars"], "with_market": ["bars", "market"], "raw": ["lp"], "suppliers": [], "quarters": ["bars"],
    "ranked": ["quarters"], "snapshots": ["ranked", "bars"], "defective": ["bars", "days"], "member": ["days", "snapshots"], "lagged": ["bars"], "mom": ["lagged"], "fwd": ["lagged"],
}


def strategy_ctes(signal: str, n: int, long_short: bool = True, prefix: str = "", cost_bps: float = 10.0) -> tuple[dict[str, str], dict[str, list[str]]]:
    """The steps from a signal to returns: {prefix}ends, {prefix}w, {prefix}held, {prefix}turn, {prefix}ret, {prefix}inv."""
    p = prefix
    short = f"WHEN rk > n - k THEN -1e0 / k" if long_short else ""
    ctes = {
        f"{p}ends": f"SELECT max(ts) AS ts FROM {signal} WHERE sig IS NOT NULL GROUP BY date_trunc('month', ts)",
        f"{p}rank": f"""SELECT ts, ticker, rk, n, greatest(1, n // {n}) AS k FROM (SELECT ts, ticker, row_number() OVER (PARTITION BY ts ORDER BY sig DESC, ticker) AS rk,
                        count(*) OVER (PARTITION BY ts) AS n FROM {signal} WHERE sig IS NOT NULL AND ts IN (SELECT ts FROM {p}ends))""",
        f"{p}w": f"SELECT ts, ticker, w FROM (SELECT *, CASE WHEN rk <= k THEN 1e0 / k {short} END AS w FROM {p}rank {'WHERE n >= 2' if long_short else ''}) WHERE w IS NOT NULL",
        f"{p}map": f"SELECT d.ts, m.ts AS reb FROM days d ASOF JOIN (SELECT DISTINCT ts FROM {p}w) m ON d.ts >= m.ts",
        f"{p}held": f"SELECT m.ts, w.ticker, w.w FROM {p}map m JOIN {p}w w ON w.ts = m.reb",
        f"{p}dense": f"""SELECT g.ts, g.ticker, coalesce(h.w, 0e0) AS w FROM (SELECT ts, ticker FROM (SELECT DISTINCT ts FROM {p}held) CROSS JOIN (SELECT DISTINCT ticker FROM {p}held)) g
                        LEFT JOIN {p}held h USING (ts, ticker)""",
        f"{p}turn": f"SELECT ts, sum(abs(w - before)) AS turnover FROM (SELECT ts, w, coalesce(lag(w) OVER (PARTITION BY ticker ORDER BY ts), 0e0) AS before FROM {p}dense) GROUP BY ts",
        f"{p}gross": f"SELECT h.ts, coalesce(sum(h.w * f.fwd_ret), 0e0) AS g FROM {p}held h LEFT JOIN fwd f USING (ts, ticker) GROUP BY h.ts",
        f"{p}ret": f"""SELECT d.ts, coalesce(g, 0e0) AS gross_ret, coalesce(turnover, 0e0) * {cost_bps}e0 / 1e4 AS cost, coalesce(g, 0e0) - coalesce(turnover, 0e0) * {cost_bps}e0 / 1e4 AS ret
                       FROM days d LEFT JOIN {p}gross USING (ts) LEFT JOIN {p}turn USING (ts) WHERE d.ts < (SELECT max(ts) FROM days)""",
        f"{p}inv": f"SELECT * FROM {p}ret WHERE ts IN (SELECT ts FROM {p}held)",
    }
    needs = {f"{p}ends": [signal], f"{p}rank": [signal, f"{p}ends"], f"{p}w": [f"{p}rank"], f"{p}map": ["days", f"{p}w"], f"{p}held": [f"{p}map", f"{p}w"], f"{p}dense": [f"{p}held"], f"{p}turn": [f"{p}dense"],
             f"{p}gross": [f"{p}held", "fwd"], f"{p}ret": ["days", f"{p}gross", f"{p}turn"], f"{p}inv": [f"{p}ret", f"{p}held"]}
    return ctes, needs


def with_clause(query: str, names: list[str], extra: tuple[dict[str, str], dict[str, list[str]]] | None = None) -> str:
    """The query after a WITH clause that defines the named steps and all that they need."""
    ctes, needs = dict(CTES), dict(NEEDS)
    if extra:
        ctes |= extra[0]
        needs |= extra[1]
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for other in needs.get(name, []):
                add(other)
            done.append(name)

    for name in names:
        add(name)
    # used more than once in most queries, and window results must not be recomputed differently
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in done) + "\n" + query


def summary_sql(source: str) -> str:
    """The six figures of a return series with ts and ret."""
    return f"""SELECT total_return, CASE WHEN total_return >= -1 THEN pow(1 + total_return, 252e0 / n_days) - 1 END AS cagr, ann_vol, sharpe, max_drawdown, n_days FROM (
      SELECT product(1 + ret) - 1 AS total_return, stddev_samp(ret) * sqrt(252e0) AS ann_vol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252e0) AS sharpe,
             min(equity / greatest(1e0, high) - 1) AS max_drawdown, CAST(count(*) AS BIGINT) AS n_days
      FROM (SELECT *, max(equity) OVER (ORDER BY ts) AS high FROM (SELECT ts, ret, product(1 + ret) OVER (ORDER BY ts) AS equity FROM {source})))"""
