"""Scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEWS_RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("date", "url", "author", "title", "subtitle")])
OHLCV = T.StructType(
    [T.StructField("date", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)


def utc_times(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as UTC timestamps (session time zone UTC)."""
    zoneless = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def get_data(
    spark: SparkSession,
    path: str,
    filetype: str = "csv",
    schema: T.StructType | str | None = None,
    records: str | None = None,
) -> DataFrame:
    """Read csv, tsv, json, columns_json or parquet.

    ``json`` is one document whose field ``records`` holds the rows.
    ``columns_json`` is ``{column: {row: value}}``. Files need a schema except
    Parquet, which carries its own.
    """
    if filetype not in ("csv", "tsv", "json", "columns_json", "parquet"):
        raise ValueError("use 'csv', 'tsv', 'json', 'columns_json' or 'parquet'")
    if filetype == "parquet":
        return spark.read.parquet(path)
    if schema is None:
        raise ValueError(f"a schema is needed to read {filetype}")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if filetype in ("csv", "tsv"):
        return (
            spark.read.schema(kind)
            .options(header=True, multiLine=True, escape='"', sep="," if filetype == "csv" else "\t")
            .csv(path)
        )
    if filetype == "json":
        if records is None:
            raise ValueError("name the field that holds the records")
        wrapped = T.StructType([T.StructField(records, T.ArrayType(kind))])
        return spark.read.schema(wrapped).option("multiLine", True).json(path).select(F.inline(records))
    return _columns_json(spark, path, kind)


def _columns_json(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """Each column is a map from row label to value; rows meet on the label.

    A file is one JSON document, so one task parses one file; large tables should
    arrive as many files or as Parquet.
    """
    maps = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), T.StringType())) for f in kind])
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", maps).alias("d"))
    rows = doc.select("d", F.explode(F.map_keys(f"d.{kind[0].name}")).alias("row"))

    def value(f: T.StructField):
        v = F.try_element_at(F.col(f"d.{f.name}"), F.col("row"))
        if isinstance(f.dataType, T.TimestampType):
            return F.timestamp_millis(v.cast("bigint"))
        return v.cast(f.dataType)

    return rows.select(F.col("row").cast("bigint").alias("row"), *[value(f).alias(f.name) for f in kind])


def with_row_ids(df: DataFrame, name: str = "idx_news") -> DataFrame:
    """Unique ids that follow the order of the input splits (not dense)."""
    return df.withColumn(name, F.monotonically_increasing_id())
