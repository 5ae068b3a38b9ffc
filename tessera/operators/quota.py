"""Daily quotas of runs: what was used since midnight UTC, and whether one more may start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    daily_usd: float = 2.0
    daily_runs: int = 25
    per_visitor: int = 10
    queue: int = 5
    reserve_usd: float = 0.45


def usage(runs: DataFrame) -> DataFrame:
    """(day, visitor, spend, runs) of each UTC day."""
    day = F.window("created_at", "1 day")["start"].cast("date")
    return runs.groupBy(day.alias("day"), "visitor").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spend"), F.count(F.lit(1)).alias("runs"))


def decision(spend: Column, runs: Column, mine: Column, queued: Column, limits: Limits) -> Column:
    """The first limit that forbids a run; the reserve is what a run may cost at worst, so no cap is crossed."""
    return (
        F.when(spend + limits.reserve_usd > limits.daily_usd, "over_budget")
        .when(runs >= limits.daily_runs, "over_runs")
        .when(mine >= limits.per_visitor, "over_visitor")
        .when(queued >= limits.queue, "queue_full")
        .otherwise("admitted")
    )


def end_of_day(runs: DataFrame, limits: Limits) -> DataFrame:
    """(day, visitor, spend, runs, decision): whether each visitor could start another run when the day's were done."""
    own = usage(runs)
    total = own.groupBy("day").agg(F.sum("spend").alias("_spend"), F.sum("runs").alias("_runs"))
    out = own.join(total, "day")
    return out.select("day", "visitor", "spend", "runs", decision(F.col("_spend"), F.col("_runs"), F.col("runs"), F.lit(0), limits).alias("decision"))


def runs_left(day: DataFrame, limits: Limits) -> DataFrame:
    """day (spend, runs, mine) with runs_left."""
    rest = F.greatest(F.lit(0), F.least(limits.daily_runs - F.col("runs"), limits.per_visitor - F.col("mine")))
    return day.withColumn("runs_left", F.when(F.col("spend") + limits.reserve_usd > limits.daily_usd, 0).otherwise(rest))


def state_at(runs: DataFrame) -> DataFrame:
    """Each run with what its day had used before it: spend_before and runs_before over all visitors, mine_before for its own.

    A day is taken minute by minute: windows run within a minute, and what the minutes before have used, at most 1,440
    rows a day, is added to them. So no task holds a day's runs.
    """
    at = F.col("created_at")
    rows = runs.withColumns({"day": F.to_date(at), "_minute": F.hour(at) * 60 + F.minute(at)})
    inside = lambda *keys: Window.partitionBy(*keys, "_minute").orderBy("created_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_spend": F.coalesce(F.sum("cost").over(inside("day")), F.lit(0.0)), "_runs": F.count(F.lit(1)).over(inside("day")), "_mine": F.count(F.lit(1)).over(inside("day", "visitor"))})

    def earlier(keys: list[str], **sums: str) -> DataFrame:
        """What the minutes before each minute have used."""
        used = runs.select(F.to_date(at).alias("day"), (F.hour(at) * 60 + F.minute(at)).alias("_minute"), *(k for k in keys if k != "day"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.lit(1).alias("one"))
        used = used.groupBy(*keys, "_minute").agg(*(F.sum(c).alias(name) for name, c in sums.items()))
        before = Window.partitionBy(*keys).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
        found = used.select(*(F.col(k).alias(f"_k{k}") for k in keys), F.col("_minute").alias("_m"), *(F.sum(name).over(before).alias(name) for name in sums))
        return found

    def on(found: DataFrame, keys: list[str]) -> Column:
        same = F.col("_minute") == F.col("_m")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k{k}"))
        return same

    day, mine = earlier(["day"], _s="cost", _r="one"), earlier(["day", "visitor"], _v="one")
    rows = rows.join(day, on(day, ["day"]), "left").drop("_kday", "_m")
    rows = rows.join(mine, on(mine, ["day", "visitor"]), "left").drop("_kday", "_kvisitor", "_m")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    out = rows.withColumns({"spend_before": plus("_spend", "_s"), "runs_before": plus("_runs", "_r"), "mine_before": plus("_mine", "_v")})
    return out.drop("_minute", "_spend", "_runs", "_mine", "_s", "_r", "_v")


def clean_question(text: Column, least: int = 12, most: int = 300) -> Column:
    """White space collapsed; null if the rest is too short or too long."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t).between(least, most), t)


def clean_name(text: Column, most: int = 60) -> Column:
    t = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, most)
    return F.when(t != "", t)


def visitor_id(salt: str, address: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(salt), address).cast("binary"), 256), 1, 12)
