"""Research notes as nested rows: whether one may be published, what it says, which notes ask the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scoring import GATE

BACKTEST = (
    "struct<handle:string,variant:string,long_short:boolean,prediction_declared:boolean,sharpe:double,sharpe_annualised:double,runs_as_predicted:boolean,"
    "clears_confirmation_gate:boolean,prob_beats_best_of_n_trials:double,analysed:boolean,half_sharpes:array<double>,costs:map<int,double>>"
)
NOTE = (
    "note_id string, eval_key string, created_at timestamp, source string, hypothesis string, stop_reason string, completed boolean, called_required_tool boolean, "
    f"unverified array<string>, hidden boolean, backtests array<{BACKTEST}>"
)

#: The family of effects that a feature's name stands for.
FAMILIES = (
    ("^mom_", "momentum"),
    ("^ivol_", "idiosyncratic volatility"),
    ("^vol_", "volatility"),
    ("^rev_36_12", "long-term reversal"),
    ("^pct_52w_high", "52-week high"),
    ("^ret_", "short-term returns"),
    ("^sma_", "moving average"),
)


def _analysed() -> Column:
    return F.filter("backtests", lambda b: b["analysed"])


def unpublishable_reasons() -> Column:
    """Why a note may not be published: an array, empty if it may. Computed, never stored."""
    reasons = F.array(
        F.when(F.size("unverified") > 0, F.concat(F.lit("unverified numerals: "), F.size("unverified").cast("string"))),
        F.when(~F.col("completed"), F.concat(F.lit("the run was stopped: "), F.coalesce("stop_reason", F.lit("unknown")))),
        F.when(~F.col("called_required_tool"), F.lit("the results were never analysed")),
        F.when((F.size("backtests") > 0) & (F.size(_analysed()) == 0), F.lit("no backtest has statistics")),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def headline() -> Column:
    """The backtest that a note is judged by: the first analysed one, declared long/short books before others."""
    done = _analysed()
    declared = F.filter(done, lambda b: b["long_short"] & F.coalesce(b["prediction_declared"], F.lit(False)))
    books = F.filter(done, lambda b: b["long_short"])
    return F.coalesce(F.get(declared, F.lit(0)), F.get(books, F.lit(0)), F.get(done, F.lit(0)))


def judge(notes: DataFrame) -> DataFrame:
    """note_id, publishable, n_reasons, outcome, variant, both_halves_as_predicted, survives_25bps."""
    b = F.col("_b")
    sharpe = F.coalesce(b["sharpe_annualised"], b["sharpe"])
    predicted = F.coalesce(b["runs_as_predicted"], sharpe > 0, F.lit(False))
    clears = F.coalesce(b["clears_confirmation_gate"], b["prob_beats_best_of_n_trials"] >= GATE, F.lit(False))
    declared = F.coalesce(b["prediction_declared"], F.lit(False))
    outcome = (
        F.when(b.isNull(), "no_verdict")
        .when(~declared & clears, "no_verdict")
        .when(~declared, "not_confirmed")
        .when(~predicted, "contradicted")
        .when(clears, "supported")
        .otherwise("not_confirmed")
    )
    both = F.when((F.size(b["half_sharpes"]) == 2) & declared, F.forall(b["half_sharpes"], lambda s: F.coalesce(s, F.lit(0.0)) > 0))
    at_25 = F.when(F.map_contains_key(b["costs"], 25), F.coalesce(F.try_element_at(b["costs"], F.lit(25)), F.lit(0.0)) > 0)
    reasons = unpublishable_reasons()
    return notes.withColumn("_b", headline()).select(
        "note_id", (F.size(reasons) == 0).alias("publishable"), F.size(reasons).alias("n_reasons"), outcome.alias("outcome"), b["variant"].alias("variant"),
        both.alias("both_halves_as_predicted"), at_25.alias("survives_25bps"),
    )


def best_deflated(notes: DataFrame) -> DataFrame:
    """(note_id, best): the largest deflated probability of the analysed backtests."""
    return notes.select("note_id", F.array_max(F.transform(_analysed(), lambda b: b["prob_beats_best_of_n_trials"])).alias("best"))


def public(notes: DataFrame) -> DataFrame:
    """What may be shown: published notes that aren't hidden, and of those only the columns on the list."""
    may = (F.size(unpublishable_reasons()) == 0) & ~F.coalesce("hidden", F.lit(False))
    return notes.where(may).select("note_id", "created_at", "source", "hypothesis", "backtests")


def by_id(notes: DataFrame, note_id: str) -> DataFrame:
    """The note of that id, or no row."""
    return notes.where(F.col("note_id") == note_id).limit(1)


def by_key(notes: DataFrame, eval_key: str) -> DataFrame:
    """The newest note of a registered anomaly, or no row."""
    return recent(notes.where(F.col("eval_key") == eval_key), 1)


def counts(notes: DataFrame) -> DataFrame:
    """(total, publishable, unpublishable), by the rule and not by a stored column."""
    may = F.count_if(F.size(unpublishable_reasons()) == 0)
    return notes.agg(F.count(F.lit(1)).alias("total"), may.alias("publishable"), (F.count(F.lit(1)) - may).alias("unpublishable"))


def recent(notes: DataFrame, k: int) -> DataFrame:
    return notes.orderBy(F.desc("created_at"), "note_id").limit(k)


def group_questions(notes: DataFrame) -> DataFrame:
    """(question, lead, n_runs, first, last): notes on the same effect, or else with the same words.

    A note_id counts once, its first row by created_at. The lead is the newest publishable note that wasn't live,
    else the newest publishable, else the newest.
    """
    once = Window.partitionBy("note_id").orderBy("created_at")
    rows = notes.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    tested = F.coalesce(headline()["variant"], F.get(F.col("backtests"), F.lit(0))["variant"])
    feature = F.trim(F.split_part(tested, F.lit(","), F.lit(1)))
    family = F.lit(None).cast("string")
    for pattern, name in reversed(FAMILIES):
        family = F.when(F.col("_f").rlike(pattern), name).otherwise(family)
    words = F.trim(F.regexp_replace(F.lower("hypothesis"), "[^a-z0-9]+", " "))
    rows = rows.withColumn("_f", F.when(feature != "", feature))
    key = F.when(F.col("_f").isNotNull(), F.concat(F.lit("effect:"), F.coalesce(family, F.col("_f")))).otherwise(F.concat(F.lit("text:"), words))
    may = F.size(unpublishable_reasons()) == 0
    rank = F.when(may & (F.col("source") != "live"), 0).when(may, 1).otherwise(2)
    rows = rows.select(key.alias("question"), "note_id", "created_at", rank.alias("_rank"))
    lead = F.min_by("note_id", F.struct("_rank", (-F.unix_micros("created_at")).alias("t"), "note_id"))
    return rows.groupBy("question").agg(lead.alias("lead"), F.count(F.lit(1)).alias("n_runs"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
