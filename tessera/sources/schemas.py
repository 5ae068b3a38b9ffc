"""Declared schemas: nothing is inferred, and an empty frame has its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BARS = "ticker string, ts date, open double, high double, low double, close double, volume bigint, vwap double, n_trades bigint"
SNAPSHOTS = "ticker string, index_name string, as_of date"
INGEST_LOG = "ticker string, from_date date, to_date date, n_rows int, ingested_at timestamp"
VERDICTS = (
    "eval_key string, universe string, run_at timestamp, registry_sha string, rule_version int, verdict string, direction int, oriented_sharpe double, "
    "published_sharpe double, p_value double, p_value_adjusted double, deflated_psr double, n_trials int, reasons array<string>"
)
RAW_BARS = "results array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double,vw:double,n:double>>"
LIVE_RUNS = "run_id string, created_at timestamp, finished_at timestamp, visitor string, display_name string, hypothesis string, status string, note string, error string, cost_usd double, hidden boolean"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
