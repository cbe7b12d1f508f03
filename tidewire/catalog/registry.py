"""Registry, table access and rounding shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources import readers

# Wide texts whose per-row work is worth a shuffle when the file has one split.
TEXTS = {"documents", "pages"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; zone-less timestamps become UTC timestamps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = readers.utc_times(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return readers.spread(df) if name in TEXTS else df


def r6(c: Column | str) -> Column:
    """Six decimals, never minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0.0 AS DOUBLE))"


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sstamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
