"""Contiguous shards of nearly equal bytes from prefix sums over partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.common import partitions, store

#: Bytes a row takes beside its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deal all rows of ``docs`` into ``shards`` contiguous runs of nearly equal bytes.

    Rows are ranged by doc_id (ties: the text's checksum, then an arbitrary but
    stored number, so that one hot doc_id spreads over several ranges). Each range
    gives its total; the running sum of the totals, one row per range, places every
    row on one line of bytes; a row goes to the shard its midpoint falls in. Two
    shards therefore differ by less than two rows' sizes.

    Returns doc_id, size (bytes of the text plus 8), text_crc32, shard, slot
    (gapless from 0 in the shard) and the columns named in ``carry``. A null text
    has no bytes; a null doc_id sorts first; repeated rows keep their own places; an
    empty table gives no rows; with fewer rows than shards some shards stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.struct(*carry).alias("_carried") if carry else F.lit(None).cast("int").alias("_carried"),
    ).withColumn("_tie", F.rand(7))
    order = ["doc_id", "text_crc32", "_tie"]
    ranged = store(
        rows.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    )
    # One row per range, as many as shuffle partitions: bounded.
    totals = ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_total"),
    )
    inside = W.partitionBy("_range").orderBy(*order)
    placed = (
        ranged.withColumn("_end", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(inside))
        .join(F.broadcast(carried), "_range")
        .withColumn("_nth", F.col("_nth") + F.col("_rows_before"))
        .withColumn("_middle", 2 * (F.col("_end") + F.col("_bytes_before")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(_middle * {shards} div (2 * _total) as int)"))
    )
    first = placed.groupBy("shard").agg(F.min("_nth").alias("_first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_nth") - F.col("_first")).cast("bigint").alias("slot"),
        *[F.col("_carried")[c].alias(c) for c in carry],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write doc_id and text as one folder per shard, rows in slot order."""
    dealt = shard_by_bytes(docs, shards, carry=("text",))
    dealt.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
