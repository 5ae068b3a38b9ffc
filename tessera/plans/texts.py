"""Queries over texts, notes and runs: numerals and their provenance, verdicts of notes, quotas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import notes, provenance, quota
from tessera.plans.adapters import Inputs
from tessera.plans.panels import rounded
from tessera.plans.catalogue import query

_NUMERAL = provenance.NUMERAL
_FOUND = "SELECT {0}, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS literal FROM (SELECT {0}, regexp_extract_all({1}, '" + _NUMERAL + "') AS l FROM {2})"


def _numerals_sql(key: str, text: str, source: str) -> str:
    return f"SELECT *, TRY_CAST(replace(literal, ',', '') AS DOUBLE) AS value FROM ({_FOUND.format(key, text, source)}) WHERE TRY_CAST(replace(literal, ',', '') AS DOUBLE) IS NOT NULL"


@query(_numerals_sql("doc_id", "text", "documents"))
def numerals(p: Inputs) -> DataFrame:
    """Every numeral of every document."""
    return provenance.numerals(p.table("documents"), "doc_id")


_ROUNDS = " UNION ALL ".join(["SELECT grp, s AS candidate FROM scaled", *(f"SELECT grp, round_even(s, {k}) FROM scaled" for k in range(5))])
_PROVENANCE = f"""WITH said AS ({_numerals_sql('doc_id', 'text', 'documents')}), shown AS (SELECT doc_id // 20 AS grp, value FROM ({_numerals_sql('doc_id', 'text', 'documents')}) WHERE doc_id % 2 = 0),
scaled AS (SELECT grp, unnest([v, v * 100, v / 100, v / 252]) AS s FROM (SELECT grp, unnest([value, -value]) AS v FROM shown)),
allowed AS (SELECT DISTINCT grp, candidate FROM ({_ROUNDS})),
judged AS (SELECT doc_id // 20 AS grp, CASE WHEN value = floor(value) AND abs(value) <= 12 THEN 'exempt'
  WHEN EXISTS (SELECT 1 FROM allowed a WHERE a.grp = s.doc_id // 20 AND abs(s.value - a.candidate) <= 0.005 * greatest(1, abs(a.candidate))) THEN 'verified' ELSE 'unverified' END AS status FROM said s WHERE doc_id % 2 = 1)
SELECT grp, CAST(count(*) FILTER (WHERE status <> 'exempt') AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE status = 'verified') AS BIGINT) AS verified, CAST(count(*) FILTER (WHERE status = 'exempt') AS BIGINT) AS exempt,
       count(*) FILTER (WHERE status = 'unverified') = 0 AS ok FROM judged GROUP BY grp"""


@query(_PROVENANCE)
def provenance_report(p: Inputs) -> DataFrame:
    """Blocks of twenty documents as runs: the odd ones are checked against what the even ones show."""
    docs = p.table("documents").select(F.expr("doc_id div 20").alias("grp"), "doc_id", "text")
    # one note a block: its texts in order, so that each numeral keeps a place of its own
    said = docs.where("doc_id % 2 = 1").groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda s: s["text"]), "\n \n").alias("text"))
    return provenance.report(provenance.check(said, docs.where("doc_id % 2 = 0"), "grp"), "grp")


# --- notes: rows made from the events by a rule, in Spark and in SQL alike ----------------------------------

FEATURES = ("mom_12_1", "vol_63d", "ivol_63d", "ret_21d", "rev_36_12", "pct_52w_high", "sma_200d", "other_1")


def _notes(p: Inputs) -> DataFrame:
    e = p.table("events").select(F.col("event_id").alias("i"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    at = lambda values, x: F.element_at(F.array(*[F.lit(v) for v in values]), (x + 1).cast("int"))

    def trial(k):  # noqa: ANN001, ANN202
        x = F.col("i") * 3 + k
        sharpe = ((x * 7) % 21 - 8) / 10.0
        return F.struct(
            F.concat(F.lit("backtest_"), k.cast("string")).alias("handle"), F.concat(at(FEATURES, (F.col("i") + k) % len(FEATURES)), F.lit(", 5 buckets")).alias("variant"), (x % 4 != 1).alias("long_short"),
            (x % 3 != 0).alias("prediction_declared"), sharpe.alias("sharpe"), F.lit(None).cast("double").alias("sharpe_annualised"), F.when(x % 5 != 0, sharpe > 0).alias("runs_as_predicted"),
            F.lit(None).cast("boolean").alias("clears_confirmation_gate"), ((x * 11) % 40 / 40.0 + 0.02).alias("prob_beats_best_of_n_trials"), (x % 6 != 2).alias("analysed"),
            F.array(((x % 7) - 2).cast("double"), ((x % 5) - 1).cast("double")).alias("half_sharpes"),
            F.create_map(F.lit(0), sharpe + 0.1, F.when(x % 2 == 0, F.lit(25)).otherwise(F.lit(10)), sharpe - 0.1).alias("costs"),
        )

    trials = F.transform(F.when(F.col("i") % 4 > 0, F.sequence(F.lit(0), (F.col("i") % 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), trial)
    return e.select(
        F.concat(F.lit("n"), F.col("i").cast("string")).alias("note_id"), F.lit(None).cast("string").alias("eval_key"), F.col("ts").alias("created_at"), F.when(F.col("i") % 3 == 0, "live").otherwise("research").alias("source"),
        F.concat(F.lit("Do  LOW-vol names win? #"), (F.col("i") % 9).cast("string")).alias("hypothesis"), F.when(F.col("i") % 10 == 0, "max_turns").otherwise("end_turn").alias("stop_reason"),
        (F.col("i") % 10 != 0).alias("completed"), (F.col("i") % 8 != 3).alias("called_required_tool"), F.when(F.col("i") % 6 == 5, F.array(F.lit("0.71"))).otherwise(F.array().cast("array<string>")).alias("unverified"),
        (F.col("i") % 25 == 1).alias("hidden"), trials.alias("backtests"),
    )


_FEATURE_LIST = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
_NOTES_SQL = f"""base AS (SELECT event_id AS i, ts FROM events),
trials AS (SELECT *, i * 3 + k AS x, ((i * 3 + k) * 7 % 21 - 8) / 10e0 AS sharpe FROM (SELECT i, unnest(range(0, i % 4)) AS k FROM base)),
t AS (SELECT *, {_FEATURE_LIST}[CAST((i + k) % {len(FEATURES)} + 1 AS INTEGER)] || ', 5 buckets' AS variant, x % 4 <> 1 AS long_short, x % 3 <> 0 AS declared, coalesce(CASE WHEN x % 5 <> 0 THEN sharpe > 0 END, sharpe > 0) AS predicted,
      x * 11 % 40 / 40e0 + 0.02e0 AS prob, x % 6 <> 2 AS analysed FROM trials),
head AS (SELECT * FROM t WHERE analysed QUALIFY row_number() OVER (PARTITION BY i ORDER BY CASE WHEN long_short AND declared THEN 0 WHEN long_short THEN 1 ELSE 2 END, k) = 1),
reasons AS (SELECT i, ts, (CASE WHEN i % 6 = 5 THEN 1 ELSE 0 END) + (CASE WHEN i % 10 = 0 THEN 1 ELSE 0 END) + (CASE WHEN i % 8 = 3 THEN 1 ELSE 0 END)
      + (CASE WHEN i % 4 > 0 AND i NOT IN (SELECT i FROM t WHERE analysed) THEN 1 ELSE 0 END) AS n_reasons FROM base)"""


@query(f"""WITH {_NOTES_SQL} SELECT 'n' || r.i AS note_id, n_reasons = 0 AS publishable, n_reasons,
  CASE WHEN h.i IS NULL THEN 'no_verdict' WHEN NOT declared AND prob >= 0.95 THEN 'no_verdict' WHEN NOT declared THEN 'not_confirmed' WHEN NOT predicted THEN 'contradicted' WHEN prob >= 0.95 THEN 'supported' ELSE 'not_confirmed' END AS outcome,
  variant, CASE WHEN declared THEN x % 7 - 2 > 0 AND x % 5 - 1 > 0 END AS both_halves_as_predicted, CASE WHEN x % 2 = 0 THEN sharpe - 0.1e0 > 0 END AS survives_25bps FROM reasons r LEFT JOIN head h USING (i)""")
def note_verdict(p: Inputs) -> DataFrame:
    return notes.judge(_notes(p))


@query(f"WITH {_NOTES_SQL} SELECT 'n' || i AS note_id, round(max(prob), 10) AS best FROM base LEFT JOIN (SELECT * FROM t WHERE analysed) USING (i) GROUP BY i")
def best_deflated(p: Inputs) -> DataFrame:
    return rounded(notes.best_deflated(_notes(p)), "best", places=10)


@query(f"WITH {_NOTES_SQL} SELECT 'n' || i AS note_id, CASE WHEN i % 3 = 0 THEN 'live' ELSE 'research' END AS source FROM reasons WHERE n_reasons = 0 AND i % 25 <> 1")
def public_notes(p: Inputs) -> DataFrame:
    return notes.public(_notes(p)).select("note_id", "source")


@query(f"WITH {_NOTES_SQL} SELECT 'n' || i AS note_id FROM base ORDER BY ts DESC, 'n' || i LIMIT 20")
def recent_notes(p: Inputs) -> DataFrame:
    return notes.recent(_notes(p), 20).select("note_id")


@query(f"WITH {_NOTES_SQL} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE n_reasons = 0) AS BIGINT) AS publishable, CAST(count(*) FILTER (WHERE n_reasons > 0) AS BIGINT) AS unpublishable FROM reasons")
def note_counts(p: Inputs) -> DataFrame:
    return notes.counts(_notes(p))


@query(f"WITH {_NOTES_SQL} SELECT 'n' || i AS note_id, n_reasons FROM reasons WHERE i = 77")
def note_by_id(p: Inputs) -> DataFrame:
    return notes.by_id(_notes(p), "n77").select("note_id", F.size(notes.unpublishable_reasons()).alias("n_reasons"))


_CONTEXT = "replace(substr(text, CAST(greatest(0, place - 40) AS INTEGER) + 1, CAST(place + length(literal) + 40 - greatest(0, place - 40) AS INTEGER)), chr(10), ' ')"


@query(f"""WITH found AS (SELECT item_id, text, unnest(range(len(l))) AS pos, unnest(l) AS literal, unnest(g[1:len(l)]) AS gap
  FROM (SELECT item_id, text, regexp_extract_all(text, '{_NUMERAL}') AS l, string_split_regex(text, '{_NUMERAL}') AS g FROM (SELECT item_id, text || ' ' || item_id || ' of 1,250.5 at -3' AS text FROM benchmark))),
placed AS (SELECT *, coalesce(sum(length(gap) + length(literal)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS place FROM found)
SELECT item_id, CAST(pos AS INTEGER) AS pos, {_CONTEXT} AS context FROM placed""")
def numeral_contexts(p: Inputs) -> DataFrame:
    """Every numeral of the benchmark's items, each with a few added, between the words around it."""
    texts = p.table("benchmark").select("item_id", F.concat("text", F.lit(" "), F.col("item_id").cast("string"), F.lit(" of 1,250.5 at -3")).alias("text"))
    return provenance.contexts(texts, "item_id")


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(f, '{pattern}') THEN '{name}'" for pattern, name in notes.FAMILIES) + " ELSE f END"


@query(f"""WITH {_NOTES_SQL}, tested AS (SELECT r.*, trim(split_part(coalesce(h.variant, t0.variant), ',', 1)) AS f FROM reasons r LEFT JOIN head h USING (i) LEFT JOIN (SELECT i, variant FROM t WHERE k = 0) t0 USING (i)),
keyed AS (SELECT *, CASE WHEN f IS NOT NULL AND f <> '' THEN 'effect:' || {_FAMILY} ELSE 'text:do low vol names win ' || i % 9 END AS question, CASE WHEN n_reasons = 0 AND i % 3 <> 0 THEN 0 WHEN n_reasons = 0 THEN 1 ELSE 2 END AS rk FROM tested)
SELECT question, 'n' || arg_min(i, (rk, -epoch_us(ts), 'n' || i)) AS lead, CAST(count(*) AS BIGINT) AS n_runs, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM keyed GROUP BY 1""")
def group_questions(p: Inputs) -> DataFrame:
    twice = _notes(p).unionByName(_notes(p).where("note_id like 'n1%'"))
    out = notes.group_questions(twice)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first", "last")})


LIMITS = quota.Limits(daily_usd=700.0, daily_runs=1500, per_visitor=8)
_DAY = "SELECT CAST(ts AS DATE) AS day, user_id AS visitor, sum(value / 100) AS spend, CAST(count(*) AS BIGINT) AS runs FROM events GROUP BY 1, 2"


@query(f"""WITH u AS ({_DAY}), d AS (SELECT day, sum(spend) AS s, sum(runs) AS r FROM u GROUP BY 1)
SELECT day, visitor, round(spend, 6) AS spend, runs, CASE WHEN s + {LIMITS.reserve_usd}e0 > {LIMITS.daily_usd}e0 THEN 'over_budget' WHEN r >= {LIMITS.daily_runs} THEN 'over_runs' WHEN runs >= {LIMITS.per_visitor} THEN 'over_visitor' ELSE 'admitted' END AS decision FROM u JOIN d USING (day)""")
def quota_day(p: Inputs) -> DataFrame:
    return rounded(quota.end_of_day(p.runs, LIMITS), "spend", places=6)


@query("""SELECT event_id AS run_id, CAST(count(*) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS runs_before,
CAST(count(*) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS mine_before,
round(coalesce(sum(value / 100) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS spend_before FROM events""")
def quota_state(p: Inputs) -> DataFrame:
    return rounded(quota.state_at(p.runs).select("run_id", "runs_before", "mine_before", "spend_before"), "spend_before", places=6)


@query("SELECT CAST(ts AS DATE) AS day, round(sum(value / 100), 6) AS spend, CAST(count(*) AS BIGINT) AS runs FROM events GROUP BY 1")
def stream_quota(p: Inputs) -> DataFrame:
    """The daily totals, from the events as a stream of files."""
    from tessera.streaming import quota_stream

    events = quota_stream.read_events(p.spark, p.sf_dir, p.table("events"), "events.parquet")
    runs = events.select(F.col("ts").cast("timestamp").alias("created_at"), (F.col("value") / 100).alias("cost"))
    out = quota_stream.into_memory(quota_stream.totals(runs), f"quota_{uuid.uuid4().hex}")
    return rounded(out.select(F.to_date("window.start").alias("day"), "spend", "runs"), "spend", places=6)
