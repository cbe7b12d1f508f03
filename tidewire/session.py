"""Session settings, lineage cutting and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only after its values are measured: at most this many bytes.
BROADCAST_BYTES = 64 << 20


def local_session(cpus: str | int = "*", app: str = "tidewire") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder: on
    a cluster a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is not None:
        return
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewire-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later jobs read the stored rows, not the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Size of one value: 8 bytes and what texts, arrays and structs hold."""
    word = F.lit(8).cast("bigint")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        held = F.octet_length(c).cast("bigint")
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        held = F.size(c) * word
    elif isinstance(kind, T.ArrayType):
        held = F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + _bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        held = sum((_bytes(c[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    elif isinstance(kind, T.MapType):
        held = _bytes(F.map_entries(c), T.ArrayType(T.StructType().add("key", kind.keyType).add("value", kind.valueType)))
    else:
        return word
    return word + F.coalesce(held, F.lit(0).cast("bigint"))


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Store ``df`` and mark it for broadcast if its values take at most ``max_bytes``.

    The measurement and the broadcast read the stored rows, so the plan behind them
    runs once. Larger sides come back unmarked and Spark joins them by shuffle.
    """
    stored = cut_lineage(df)
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in stored.schema), F.lit(16).cast("bigint"))
    return F.broadcast(stored) if (stored.agg(F.sum(width)).first()[0] or 0) <= max_bytes else stored
