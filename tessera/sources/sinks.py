"""Sinks: insert-ignore, upserts, deletes, reconciled copies, and documents as JSON, Markdown or text."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_KEYS, SNAPSHOT_KEYS, VERDICT_KEYS = ("ticker", "ts"), ("ticker", "index_name", "as_of"), ("eval_key", "universe")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing, and of new the rows whose keys it lacks, one of each: the first write wins."""
    fresh = new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """One row per key, the one with the largest `at`; of equal ones the new one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_new")


def upsert_partial(existing: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """upsert where the key is given; rows without it accumulate."""
    keyed = upsert(existing.where(F.col(key).isNotNull()), new.where(F.col(key).isNotNull()), [key], at)
    return keyed.unionByName(existing.where(F.col(key).isNull())).unionByName(new.where(F.col(key).isNull()))


def delete(existing: DataFrame, gone: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """(what is left, whether anything went)."""
    hit = existing.join(gone.select(*keys).distinct(), list(keys), "left_semi")
    return existing.join(gone.select(*keys).distinct(), list(keys), "left_anti"), not hit.isEmpty()


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites a Parquet table that df may itself read: written beside it first, then moved."""
    _move(df.sparkSession, _beside(df, path), path)


def _beside(df: DataFrame, path: str) -> str:
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    return beside


def _move(spark: SparkSession, beside: str, path: str) -> None:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    if not fs.rename(fs_path(beside), fs_path(path)):
        raise OSError(f"{beside} couldn't be moved to {path}")


def append_new(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows of new whose keys the table lacks; returns the rows attempted."""
    attempted = new.count()
    rows = new.dropDuplicates(list(keys))
    try:
        rows = rows.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)
    return attempted


def not_ingested(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """The jobs (ticker, from_date, to_date) that the log lacks."""
    return jobs.join(log, ["ticker", "from_date", "to_date"], "left_anti")


def ingest(jobs: Sequence[tuple], one: Callable[..., int]) -> dict[str, str]:
    """Runs one(*job) for each job; a failure is recorded under the ticker and doesn't stop the rest."""
    failed = {}
    for job in jobs:
        try:
            one(*job)
        except Exception as e:  # noqa: BLE001
            failed[str(job[0])] = f"{type(e).__name__}: {e}"
    return failed


def copy_table(spark: SparkSession, source: str, target: str) -> int:
    """Replaces target by source and checks the rows; refuses an empty source or one that is the target."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("source and target are the same")
    n = spark.read.parquet(source).count()
    if not n:
        raise ValueError("the source is empty")
    beside = _beside(spark.read.parquet(source), target)
    if (m := spark.read.parquet(beside).count()) != n:  # the target is still what it was
        raise ValueError(f"{m} rows arrived of {n}")
    _move(spark, beside, target)
    return n


def plain(value: object) -> object:
    """A JSON-safe copy: NaN and infinities are null, dates are text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def to_document(rows: DataFrame, most: int = 10_000) -> str:
    """The rows of a frame as one JSON array; more than `most` rows are an error, as they are no document."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write them as a table")
    return json.dumps([plain(r.asDict(recursive=True)) for r in found], sort_keys=True)


def from_document(spark: SparkSession, text: str, schema: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "d string").select(F.explode(F.from_json("d", f"array<struct<{_colons(schema)}>>")).alias("r")).select("r.*")


def _colons(schema: str) -> str:
    """A DDL list of columns as the inside of a struct type."""
    out, depth = [], 0
    for part in schema.replace("\n", " ").split(","):
        if depth == 0:
            name, kind = part.strip().split(" ", 1)
            part = f"{name}:{kind}"
        depth += part.count("<") - part.count(">")
        out.append(part)
    return ",".join(out)


def number(value: float | None, places: int = 2, share: bool = False) -> str:
    if value is None or not math.isfinite(value):
        return "n/a"
    return f"{value:.{places}%}" if share else f"{value:.{places}f}"


def markdown(title: str, prose: str, backtests: Sequence[dict], warnings: Sequence[str] = ()) -> str:
    """A note as Markdown: why it can't be published, if so; a table of its backtests; the prose."""
    head = [f"# {title}", "", *(f"> **Not publishable:** {w}" for w in warnings)]
    table = ["| backtest | Sharpe | total return | max drawdown | P(beats best of N) |", "| --- | ---: | ---: | ---: | ---: |"]
    for b in backtests:
        table.append(f"| {b.get('variant', '')} | {number(b.get('sharpe'))} | {number(b.get('total_return'), share=True)} | {number(b.get('max_drawdown'), share=True)} | {number(b.get('prob_beats_best_of_n_trials'))} |")
    return "\n".join([*head, "", *table, "", prose, ""])


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    """The distinct values, sorted, one a line in one file: for lists that a reader opens."""
    rows.select(column).distinct().orderBy(column).coalesce(1).write.mode("overwrite").text(path)
