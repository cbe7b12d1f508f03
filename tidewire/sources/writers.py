"""Sinks. Every write replaces what the path held."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# One dataset for all model choices: readers prune by these folders.
MODEL_KEYS = ["sent_model", "emb_model", "clust_algo", "opti_method"]


def save_data(df: DataFrame, path: str, filetype: str = "csv", partition_by: Iterable[str] = ()) -> None:
    """Write csv (with header), json (one object per line) or parquet."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if filetype == "csv":
        writer.options(header=True, escape='"').csv(path)
    elif filetype == "json":
        writer.json(path)
    elif filetype == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("use 'csv', 'json' or 'parquet'")


def save_lines(spark: SparkSession, items: DataFrame | Iterable, path: str, filetype: str = "txt") -> None:
    """One item per line. A frame contributes its first column."""
    if filetype != "txt":
        raise ValueError("use 'txt'")
    if isinstance(items, DataFrame):
        lines = items.select(items[items.columns[0]].cast("string"))
    else:
        lines = spark.createDataFrame([(str(x),) for x in items], "value string")
    lines.write.mode("overwrite").text(path)


def save_model_output(df: DataFrame, path: str, keys: Iterable[str] = MODEL_KEYS) -> None:
    """Parquet partitioned by the model-choice columns the frame has."""
    save_data(df, path, "parquet", [k for k in keys if k in df.columns])
