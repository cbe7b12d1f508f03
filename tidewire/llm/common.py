"""Intermediate tables, table access and column helpers shared by the operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ensure_checkpoint_dir

#: Words everywhere in this package: runs of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Later jobs read the stored columns they need, so nothing upstream runs twice
    and a lost executor costs a re-read. The files go when the driver's JVM ends,
    or earlier through ``discard``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


#: Buckets of a stored table at most: Spark's own limit.
BUCKETS = 100_000


def store_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``store`` as a table whose rows lie in hash buckets of ``key``, one per shuffle partition at least.

    Grouping the stored rows by ``key`` moves none of them. ``discard`` drops the table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"table_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    df.write.bucketBy(min(max(partitions(spark), buckets), BUCKETS), key).option("path", path).saveAsTable(name)
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    stored = spark.table(name)
    stored._stored_at, stored._name = path, name
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads, and the shuffle files nobody holds."""
    for t in tables:
        if hasattr(t, "_name"):
            t.sparkSession.sql(f"DROP TABLE {t._name}")
        at, fs = _place(t.sparkSession, t._stored_at)
        fs.delete(at, True)
    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
