"""Daily quotas over a stream of runs: tumbling windows of a UTC day, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """A stream of Parquet files with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", glob).parquet(folder)


def daily_usage(runs: DataFrame, late: str = "1 day") -> DataFrame:
    """(window, visitor, spend, runs) of a stream of runs (created_at, visitor, cost)."""
    rows = runs.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day"), "visitor")
    return rows.agg(F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("runs"))


def totals(runs: DataFrame, late: str = "1 day") -> DataFrame:
    """(window, spend, runs) of each day over all visitors."""
    return runs.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day")).agg(F.sum("cost").alias("spend"), F.count(F.lit(1)).alias("runs"))


def into_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to a Parquet table, each exactly once; the checkpoint makes it resume where it stopped."""
    return rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def into_memory(rows: DataFrame, name: str) -> DataFrame:
    """Runs what there is of a stream to its end and returns the whole result; for small results and tests."""
    query = rows.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
