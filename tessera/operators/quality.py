"""Quality gates of a price panel: gaps, level shifts, and where a series is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import series

MAX_GAP, MAX_RATIO, MIN_COVERAGE = 10, 4.0, 0.5


def coverage_gaps(panel: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """(ticker, ts, gap_days): the last row before each hole of more than max_gap days."""
    gap = F.datediff(F.lead("ts").over(series()), F.col("ts"))
    return panel.select("ticker", "ts", gap.alias("gap_days")).where(F.col("gap_days") > max_gap)


def level_shifts(panel: DataFrame, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(ticker, ts, close, next_close, ratio): rows whose next close is beyond the ratio, up or down; strictly."""
    out = panel.where(F.col("close").isNotNull()).select("ticker", "ts", "close", F.lead("close").over(series()).alias("next_close"))
    out = out.withColumn("ratio", F.try_divide("next_close", "close"))
    return out.where((F.col("ratio") > max_ratio) | (F.col("ratio") < 1 / max_ratio))


def _marked(panel: DataFrame, max_gap: int, max_ratio: float) -> DataFrame:
    """panel with _gap and _ratio where a row is the last before a hole or a level shift, null elsewhere: one window for both."""
    gap = F.datediff(F.lead("ts").over(series()), F.col("ts"))
    ratio = F.try_divide(F.expr("lead(close) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY ts)"), F.col("close"))
    out = panel.withColumns({"_gap": gap, "_ratio": ratio})
    shifted = (F.col("_ratio") > max_ratio) | (F.col("_ratio") < 1 / max_ratio)
    return out.withColumns({"_gap": F.when(F.col("_gap") > max_gap, F.col("_gap")), "_ratio": F.when(shifted, F.col("_ratio"))})


def flag_suspects(panel: DataFrame, max_gap: int = MAX_GAP, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(ticker, reason, ts, size): one defect per ticker; a level shift comes before a gap, then the largest first."""
    rows = _marked(panel, max_gap, max_ratio)
    defect = lambda size, reason: F.when(F.col(size).isNotNull(), F.struct(F.lit(reason).alias("reason"), "ts", F.col(size).cast("double").alias("size")))
    rows = rows.select("ticker", F.explode(F.array_compact(F.array(defect("_ratio", "level_shift"), defect("_gap", "coverage_gap")))).alias("d"))
    first = F.struct((F.col("d.reason") == "coverage_gap").alias("o"), (-F.col("d.size")).alias("s"), "d.ts")
    return rows.groupBy("ticker").agg(F.min_by("d", first).alias("d")).select("ticker", "d.reason", "d.ts", "d.size")


def drop_suspects(panel: DataFrame, max_gap: int = MAX_GAP, max_ratio: float = MAX_RATIO) -> DataFrame:
    """The whole-sample gate: a ticker with any defect goes. It looks ahead, and is there for comparison."""
    rows = _marked(panel, max_gap, max_ratio)
    bad = F.max((F.col("_gap").isNotNull() | F.col("_ratio").isNotNull())).over(Window.partitionBy("ticker"))
    return rows.withColumn("_bad", bad).where(~F.col("_bad")).select(*panel.columns)


def _cut(panel: DataFrame, max_gap: int, max_ratio: float) -> DataFrame:
    """panel with last_kept and reason of its ticker's first defect: the windows share one exchange, and nothing is joined."""
    rows = _marked(panel, max_gap, max_ratio)
    reason = F.when(F.col("_gap").isNotNull(), "coverage_gap").when(F.col("_ratio").isNotNull(), "level_shift")
    first = F.min(F.when(reason.isNotNull(), F.struct("ts", reason.alias("reason")))).over(Window.partitionBy("ticker"))
    return rows.withColumn("_first", first).select(*panel.columns, F.col("_first.ts").alias("last_kept"), F.col("_first.reason").alias("reason"))


def first_defects(panel: DataFrame, max_gap: int = MAX_GAP, max_ratio: float = MAX_RATIO) -> DataFrame:
    """(ticker, last_kept, reason): the first defect of each ticker; on a tie a gap comes before a shift."""
    return _cut(panel, max_gap, max_ratio).where("last_kept is not null").groupBy("ticker").agg(F.first("last_kept").alias("last_kept"), F.first("reason").alias("reason"))


def truncate_suspects(panel: DataFrame, max_gap: int = MAX_GAP, max_ratio: float = MAX_RATIO) -> tuple[DataFrame, DataFrame]:
    """The point-in-time gate: (the panel up to each ticker's first defect, a report with the rows dropped)."""
    marked = _cut(panel, max_gap, max_ratio)
    kept = marked.where(F.col("last_kept").isNull() | (F.col("ts") <= F.col("last_kept"))).select(*panel.columns)
    report = marked.where(F.col("last_kept").isNotNull()).groupBy("ticker", "last_kept", "reason")
    return kept, report.agg(F.count_if(F.col("ts") > F.col("last_kept")).alias("rows_dropped"))


def trim_ragged_end(panel: DataFrame, min_coverage: float = MIN_COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(the panel up to the last date with enough tickers, the dates cut off with their tickers).

    Enough: min_coverage of the median over all dates. Only the tail goes.
    """
    per_day = panel.groupBy("ts").agg(F.count_distinct("ticker").alias("n_tickers"))
    median = per_day.agg(F.median("n_tickers").alias("median"))
    # two one-row frames: the cross joins are constants
    last = per_day.crossJoin(F.broadcast(median)).where(F.col("n_tickers") >= min_coverage * F.col("median")).agg(F.max("ts").alias("_last"))
    kept = panel.crossJoin(F.broadcast(last)).where("ts <= _last").select(*panel.columns)
    return kept, per_day.crossJoin(F.broadcast(last)).where("ts > _last").select("ts", "n_tickers")


