"""Membership looked up as of each date: the latest snapshot on or before it, and nothing before the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.windows import dates, latest_mark


def members_as_of(snapshots: DataFrame, day: str) -> DataFrame:
    """The tickers of the latest snapshot up to the day."""
    past = snapshots.where(F.col("as_of") <= F.lit(day).cast("date"))
    return past.join(past.agg(F.max("as_of").alias("as_of")), "as_of", "left_semi").select("ticker").distinct()


def membership_panel(snapshots: DataFrame, days: DataFrame) -> DataFrame:
    """(ts, ticker) in force on each day. A snapshot is complete: whoever it lacks isn't a member."""
    marks = snapshots.select(F.col("as_of").alias("ts")).distinct()
    in_force = latest_mark(days.select("ts").distinct(), marks, "as_of")
    return in_force.join(snapshots.select("as_of", "ticker").distinct(), "as_of").select("ts", "ticker")


def dropped_names(snapshots: DataFrame, since: str | None = None) -> DataFrame:
    """Tickers of some snapshot since the day that the latest one lacks."""
    window = snapshots if since is None else snapshots.where(F.col("as_of") >= F.lit(since).cast("date"))
    latest = snapshots.join(snapshots.agg(F.max("as_of").alias("as_of")), "as_of", "left_semi")
    return window.select("ticker").distinct().join(latest.select("ticker"), "ticker", "left_anti")


def restrict(signal: DataFrame, membership: DataFrame) -> DataFrame:
    """The signal of members only; before ranking, never after, and never on prices."""
    return signal.join(membership, ["ts", "ticker"], "left_semi")


def coverage_report(membership: DataFrame, panel: DataFrame) -> DataFrame:
    """(ticker, n_member_days, n_price_days, missing_days) of every member."""
    priced = panel.select("ts", "ticker").distinct().withColumn("_has", F.lit(1))
    rows = membership.join(priced, ["ts", "ticker"], "left").groupBy("ticker")
    out = rows.agg(F.count(F.lit(1)).alias("n_member_days"), F.count("_has").alias("n_price_days"))
    return out.withColumn("missing_days", F.col("n_member_days") - F.col("n_price_days"))


def classify_missing(membership: DataFrame, panel: DataFrame) -> DataFrame:
    """(ticker, kind, days): member days without a price, before, after or between a ticker's priced days, or with none at all."""
    missing = membership.join(panel, ["ts", "ticker"], "left_anti")
    span = panel.groupBy("ticker").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    kind = F.when(F.col("_first").isNull(), "none").when(F.col("ts") < F.col("_first"), "leading").when(F.col("ts") > F.col("_last"), "trailing").otherwise("interior")
    return missing.join(span, "ticker", "left").groupBy("ticker", kind.alias("kind")).agg(F.count(F.lit(1)).alias("days"))


def gate(missing: DataFrame, gated: DataFrame, max_interior: int = 5) -> DataFrame:
    """One row: how many members lack prices altogether (gated ones aside), the longest sum of interior holes, and whether that blocks."""
    rows = missing.join(gated.select("ticker", F.lit(True).alias("_gated")), "ticker", "left")
    never = F.count_if((F.col("kind") == "none") & F.col("_gated").isNull()).alias("never_priced")
    holes = F.count_if((F.col("kind") == "interior") & (F.col("days") > max_interior)).alias("holed")
    return rows.agg(never, holes).withColumn("blocked", (F.col("never_priced") > 0) | (F.col("holed") > 0))


def spacing(snapshots: DataFrame) -> DataFrame:
    """(prev, as_of, gap_days) of consecutive snapshots."""
    marks = snapshots.select(F.col("as_of").alias("ts")).distinct().withColumn("prev", F.lag("ts").over(dates()))
    return marks.where("prev is not null").select("prev", F.col("ts").alias("as_of"), F.datediff("ts", "prev").alias("gap_days"))


#: Days between snapshots from which membership is uncertain.
LONG_GAP = 45


def long_gaps(snapshots: DataFrame, days: DataFrame, longer_than: int = LONG_GAP) -> DataFrame:
    """(prev, as_of, gap_days, inside): gaps of more than so many days, and whether one overlaps the priced days: only those cost anything now."""
    span = days.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    rows = spacing(snapshots).where(F.col("gap_days") > longer_than).crossJoin(F.broadcast(span))  # one row
    return rows.select("prev", "as_of", "gap_days", ((F.col("as_of") > F.col("_lo")) & (F.col("prev") < F.col("_hi"))).alias("inside"))


def resolution(snapshots: DataFrame, days: DataFrame) -> DataFrame:
    """One row: snapshots within the priced days, the median and the worst days between them: how late a removal may be dated."""
    span = days.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    inside = snapshots.select("as_of").distinct().crossJoin(F.broadcast(span)).where("as_of between _lo and _hi").select("as_of")
    gaps = spacing(inside).agg(F.median("gap_days").alias("median_days"), F.max("gap_days").alias("worst_days"))
    return inside.agg(F.count(F.lit(1)).alias("n_snapshots")).crossJoin(F.broadcast(gaps))


def day_clusters(membership: DataFrame) -> DataFrame:
    """(n_member_days, n_names, ends, kind): groups of names with as many member days, fewer than the most, that all end together.

    Those that end on the last day joined late; the others were removed.
    """
    per_name = membership.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_member_days"), F.max("ts").alias("_end"))
    most = membership.agg(F.count_distinct("ts").alias("_days"), F.max("ts").alias("_last"))
    rows = per_name.crossJoin(F.broadcast(most)).where("n_member_days < _days").groupBy("n_member_days", "_last")
    out = rows.agg(F.count(F.lit(1)).alias("n_names"), F.min("_end").alias("ends"), F.max("_end").alias("_to")).where("ends = _to")
    return out.select("n_member_days", "n_names", "ends", F.when(F.col("ends") == F.col("_last"), "joined late").otherwise("removed").alias("kind"))


def spells(snapshots: DataFrame) -> DataFrame:
    """(ticker, first_seen, last_seen, n_snapshots, change): whether a name joined late, was removed, or both."""
    ends = snapshots.agg(F.min("as_of").alias("_lo"), F.max("as_of").alias("_hi"))
    rows = snapshots.groupBy("ticker").agg(F.min("as_of").alias("first_seen"), F.max("as_of").alias("last_seen"), F.count_distinct("as_of").alias("n_snapshots"))
    late, gone = F.col("first_seen") > F.col("_lo"), F.col("last_seen") < F.col("_hi")
    change = F.when(late & gone, "both").when(late, "joined_late").when(gone, "removed").otherwise("always")
    return rows.crossJoin(F.broadcast(ends)).select("ticker", "first_seen", "last_seen", "n_snapshots", change.alias("change"))


def removal_clusters(snapshots: DataFrame) -> DataFrame:
    """(last_seen, n_names, gap_days): names that end together, with the space to the next snapshot."""
    ends = spells(snapshots).where(F.col("change").isin("removed", "both")).groupBy("last_seen").agg(F.count(F.lit(1)).alias("n_names"))
    next_gap = spacing(snapshots).select(F.col("prev").alias("last_seen"), "gap_days")
    return ends.join(next_gap, "last_seen", "left")


def member_days(membership: DataFrame) -> DataFrame:
    """One row: the distribution of member days over names."""
    n = membership.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("min_days"), F.median("n").alias("median_days"), F.max("n").alias("max_days"), F.count_distinct("n").alias("n_distinct"), F.count(F.lit(1)).alias("n_names"))
