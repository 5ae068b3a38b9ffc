"""Tables in the folder that all executors share: what is read often is written once, and lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder is made, in local mode only: there, one machine runs everything.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def steady(spark: SparkSession) -> SparkSession:
    """Turns off a Spark 4.1 shortcut that keeps the partitioning of a union's inputs.

    With it a plan fails ("can't zip RDDs with unequal numbers of partitions") when adaptive execution has
    coalesced the inputs differently.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


#: Bytes of a row group of tables with whole texts.
ROW_GROUP = 16 << 20


def small_groups(spark: SparkSession) -> SparkSession:
    """Makes what is written from now on Parquet row groups of ROW_GROUP bytes, unless the session has a size of its own.

    A task that writes holds a row group, and one that reads holds its columns: of whole texts, both come near
    the default of 128 MB, in each of an executor's tasks.
    """
    if not spark.conf.get("parquet.block.size", None):
        spark.conf.set("parquet.block.size", str(ROW_GROUP))
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    The table goes when the driver's Python ends, or with release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    out = df.write
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def release(*frames: DataFrame) -> None:
    """Deletes tables that stored() has written, once nothing that is still to be read depends on them."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            _delete(df.sparkSession, path)


def _drop(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass
    _delete(spark, path)


def stored_sorted(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df as a table in the shared folder, dealt into buckets by the keys and sorted by them in each.

    There are as many buckets as the session has shuffle partitions, so rows that were aggregated by the keys are
    written as they lie, and two such tables, or one and newly aggregated rows, are joined on the keys without an
    exchange; within merging() without a sort either.
    """
    spark = df.sparkSession
    path, table = f"{shared_dir(spark)}/tessera-{name}-{(mark := uuid.uuid4().hex)}", f"tessera_{name.replace('-', '_')}_{mark}"
    atexit.register(_drop, spark, table, path)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


@contextmanager
def merging(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark trusts the order of sorted buckets of one file each."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
