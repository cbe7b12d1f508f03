"""Global order without a single-task window.

A window with no partition key pulls every row into one task. Here rows are
range-partitioned on the order columns, stored once (so later jobs see the same
ranges) and numbered inside each range; the small per-range table carries the
totals of the ranges before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.session import cut_lineage

PART = "_range"


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    return cut_lineage(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def number_rows(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """1, 2, 3 … over the whole frame in the given order. Pass narrow frames."""
    parted = _ranges(df, order)
    local = F.row_number().over(W.partitionBy(PART).orderBy(*order)).cast("bigint")
    # One row per range, as many as shuffle partitions: safe to broadcast.
    counts = parted.groupBy(PART).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy(PART)) - F.col("_n")
    offsets = counts.select(PART, before.alias("_before"))
    return (
        parted.withColumn(name, local)
        .join(F.broadcast(offsets), PART)
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before", PART)
    )


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over this row and all rows before it."""
    parted = _ranges(df.withColumn(name, value.cast("bigint")), order)
    inside = W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = parted.groupBy(PART).agg(F.sum(name).alias("_n"))
    before = F.sum("_n").over(W.orderBy(PART)) - F.col("_n")
    return (
        parted.withColumn(name, F.sum(name).over(inside))
        .join(F.broadcast(sums.select(PART, before.alias("_before"))), PART)
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before", PART)
    )


def previous_row(df: DataFrame, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """Add ``columns`` (name -> expression) evaluated on the row before."""
    parted = _ranges(df, order)
    inside = W.partitionBy(PART).orderBy(*order)
    shown = F.struct(*[c.alias(n) for n, c in columns.items()])
    tails = parted.groupBy(PART).agg(F.max_by(shown, F.struct(*order)).alias("_tail"))
    carried = tails.select(PART, F.lag("_tail").over(W.orderBy(PART)).alias("_carry"))
    return (
        parted.withColumn("_prev", F.lag(shown).over(inside))
        .join(F.broadcast(carried), PART)
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
        .withColumns({n: F.col(f"_prev.{n}") for n in columns})
        .drop("_prev", "_carry", PART)
    )


def last_marked(df: DataFrame, order: list[str], mark: Column, value: Column, name: str) -> DataFrame:
    """Carry forward ``value`` of the latest row, up to this one, where ``mark`` holds."""
    parted = _ranges(df, order)
    inside = W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    marked = F.when(mark, value)
    tails = parted.groupBy(PART).agg(
        F.max_by(value, F.when(mark, F.struct(*order))).alias("_tail")
    )
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(PART, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    return (
        parted.withColumn(name, F.last(marked, ignorenulls=True).over(inside))
        .join(F.broadcast(carried), PART)
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop("_carry", PART)
    )


def split_bounds(n: int) -> tuple[int, int]:
    """Rows in train and in train + validation for the 60/20/20 split."""
    held = math.ceil(0.4 * n)
    test = math.ceil(0.5 * held)
    return n - held, n - test


def chrono_split(df: DataFrame, order: list[str], key: str) -> DataFrame:
    """Add ``rn`` and ``split`` (train, val, test) in time order, unshuffled."""
    numbered = number_rows(df.select(key, *[c for c in order if c != key]), order)
    train, val = split_bounds(numbered.count())
    split = F.when(F.col("rn") <= train, "train").when(F.col("rn") <= val, "val").otherwise("test")
    return df.join(numbered.select(key, "rn", split.alias("split")), key)


def contiguous_folds(df: DataFrame, order: list[str], key: str, folds: int = 5) -> DataFrame:
    """Add ``fold`` 0..folds-1: unshuffled, the first n mod folds one row longer."""
    numbered = number_rows(df.select(key, *[c for c in order if c != key]), order)
    size, extra = divmod(numbered.count(), folds)
    pos = F.col("rn") - 1
    long_part = extra * (size + 1)
    fold = F.when(pos < long_part, F.floor(pos / (size + 1)))
    if size:
        fold = fold.otherwise(extra + F.floor((pos - long_part) / size))
    return df.join(numbered.select(key, fold.cast("int").alias("fold")), key)
