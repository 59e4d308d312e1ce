"""Helpers that the training-data operators share: scratch tables, column names, bounded Arrow
slices and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder that the cluster names in
    ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quarry-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and a lost executor
    costs no recomputation of what stands before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def col(name: str):
    """Column by its exact name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken) -> str:
    """``name``, or a variant of it that no column in ``taken`` has (names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def arrow_slices(batches: Iterator[pa.RecordBatch], sized: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that column number ``sized`` (binary) holds about ``max_bytes`` per
    slice; one longer value is a slice of its own."""
    for b in batches:
        offsets = b.column(sized).cast(pa.large_binary())
        o = _offsets(offsets)
        i, n = 0, b.num_rows
        while i < n:
            j = i + 1
            while j < n and o[j + 1] - o[i] <= max_bytes:
                j += 1
            yield b.slice(i, j - i)
            i = j


def give_back() -> None:
    """Hand a Python worker's freed memory back to the system: workers outlive their tasks, and those
    of earlier stages would hold on to their largest step's."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def _offsets(arr: pa.Array):
    import numpy as np
    return np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]


def binary_parts(arr: pa.Array):
    """(bytes as uint8, offsets as int64 from 0) of a binary array; null counts as empty."""
    import numpy as np
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = _offsets(arr)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[o[0]:o[-1]], o - o[0]


#: Bytes of an Arrow batch between Spark and Python (Spark's own limit is 64 MB for each task and side).
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Bound this session's Arrow batches by ``most`` bytes, unless it has a smaller limit: batches of
    long texts then arrive in pieces instead of being cut once they are there."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def map_batches(df: DataFrame, schema: T.StructType, fn: Callable, sized: str | None = None) -> DataFrame:
    """``mapInArrow`` where ``fn(slice) -> RecordBatch | None`` sees bounded slices by column
    ``sized`` (text or binary)."""
    at = df.columns.index(sized) if sized else None
    small_batches(df.sparkSession)

    def run(batches):
        for b in (arrow_slices(batches, at) if at is not None else batches):
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def append_by_batch(df: DataFrame, text_col: str, fields: list[T.StructField],
                    fn: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """``df`` with further columns that ``fn`` makes from the text column (given as a binary array that
    shares the text's bytes, null kept). The caller picks names that are free."""
    names = df.columns + [f.name for f in fields]
    at = df.columns.index(text_col)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, *fn(b.column(at).cast(pa.binary()))], names=names)

    return map_batches(df, T.StructType(list(df.schema.fields) + fields), one, text_col)


#: Rows up to which a side of two or three numbers or hashes a row (64 MB at most) is broadcast.
NEAR_ROWS = 1_000_000


def near(df: DataFrame) -> DataFrame:
    """``df`` (narrow rows, stored) with a broadcast hint if its counted size allows; beyond, the
    join is left to shuffles."""
    return F.broadcast(df) if df.count() <= NEAR_ROWS else df


def pack_sorted(values):
    """Sorted uint32 values as bytes: differences, one byte plane after the other, so that the planes
    of high bytes, nearly all zero, vanish when shuffle blocks are compressed."""
    import numpy as np
    d = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_sorted(raw, n: int):
    import numpy as np
    planes = np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def planes(values):
    """Bytes of numbers, one byte plane after the other."""
    import numpy as np
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(raw, kind, n: int, at: int):
    import numpy as np
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T).view(kind).ravel()


def bucket_of(hashes, buckets: int):
    """(bucket, 32 further bits) of 64-bit hashes; both together tell hashes apart within a bucket
    of a bounded number of them but for a few in a million."""
    import numpy as np
    from quarry.llm.hashing import mix
    r = mix(hashes)
    return ((r >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (r & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (any one orderable type; null ends are ignored):
    ``(node, component)``, the component being its smallest node. Large-star / small-star rounds on
    stored tables: each round is two aggregations, a hub with a third of all edges is combined on
    the map side, and the number of rounds grows with the logarithm of the longest chain."""
    e = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
         .where("u is not null and v is not null and u <> v").distinct())
    e = stored(e, "cc")
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour (or u)
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.join(low, both.u == low.k).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, large.u == low.k)
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                   .union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "cc")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == last:
            break
        last = (state["n"], state["h"])
    else:
        raise RuntimeError("components did not settle")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select(F.col("v"), F.col("v"))).distinct())
