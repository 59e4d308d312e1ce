"""Session helpers: one place for the settings every job in the package relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(master: str | None = None, app: str = "quarry", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the cluster's own session and pass it in."""
    builder = (
        SparkSession.builder.master(master or "local[*]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Without it only a local session gets a
    temporary folder (its executors are threads of one process); on a cluster each executor would
    write to its own disk, so a missing setting is an error there."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for tables written to cut lineage."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet below the shared folder and read it back: lineage is cut, later
    passes keep column pruning and pushdown, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession, name)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes, about, up to which a side is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted with the size of their values, stay below
    ``limit``; beyond, the join is left to shuffles."""
    row = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + F.lit(8 * len(df.columns)))
    return F.broadcast(df) if (df.agg(row.alias("b")).first()["b"] or 0) <= limit else df


#: Bytes of an Arrow batch between Spark and Python (Spark's own limit is 64 MB for each task and side).
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Bound this session's Arrow batches by ``most`` bytes from now on, unless it has a smaller limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def give_back() -> None:
    """Hand a Python worker's freed memory back to the system: workers outlive their tasks."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
