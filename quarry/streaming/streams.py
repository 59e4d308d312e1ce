"""Structured Streaming jobs: the live upload limiter (stateful, per key), incremental knowledge
base growth (stateless, file sink) and live session titles (streaming aggregation, upserts).

Every job is written for incremental runs: ``trigger(availableNow=True)`` processes what has
arrived, the checkpoint carries offsets and state to the next run, and a lost executor replays
from the checkpoint. Sinks are written by epoch, and an epoch that runs again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators import chunk as K
from quarry.operators.limiter import UPLOAD_LIMIT, limit_step, micros
from quarry.session import stored

LIMIT_STATE = "kept array<bigint>, last string, latest bigint, timer bigint"
#: Rows of one frame that a key hands on.
FRAME = 10_000


class UploadLimiter(StatefulProcessor):
    """The limiter's rule (STR-1) per key. State: at most ``limit`` accepted times, the last accepted
    name, the newest event and the timer that stands. A window after the newest event the timer
    empties the accepted times; the name goes ``forget_us`` after it (None: it is kept, since the rule
    compares with it however old it is), and with it the key.

    A key's rows of a micro-batch arrive as frames; only the three values that the rule needs are held
    of them, in time order, and results leave in frames of ``FRAME`` rows."""

    def __init__(self, names: list[str], limit: int, window_us: int, forget_us: int | None):
        self.names, self.limit, self.window_us, self.forget_us = names, limit, window_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("limiter", LIMIT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        late = timerValues.getCurrentWatermarkInMs() * 1000
        ids, times, names = [], [], []
        for frame in rows:
            ids.append(frame["id"].to_numpy())
            times.append(frame["us"].to_numpy())
            names.append(frame["nm"].to_numpy(object))
        ids, times, names = np.concatenate(ids), np.concatenate(times), np.concatenate(names)
        kept, last, latest, timer = self.state.get() or ([], None, None, None)
        kept = list(kept or [])
        status, left = [], []
        order = np.lexsort((ids, times))
        for i in order:
            t = int(times[i])
            if t < late:
                status.append("late")
            else:
                name = None if pd.isna(names[i]) else names[i]
                kept, last, now = limit_step(kept, last, t, name, self.limit, self.window_us)
                status.append(now)
                latest = t if latest is None else max(latest, t)
            left.append(max(0, self.limit - len(kept)))
        if latest is not None:
            due = -(-(latest + self.window_us) // 1000)
            if timer != due:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
            self.state.update((kept, last, latest, due))
        for k in range(0, len(order), FRAME):
            part = slice(k, k + FRAME)
            yield pd.DataFrame({self.names[0]: [key[0]] * len(status[part]), self.names[1]: ids[order[part]], "status": status[part],
                                "uploads_left": np.array(left[part], np.int32)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, last, latest, _ = self.state.get()
        gone = None if self.forget_us is None else -(-(latest + self.forget_us) // 1000)
        if gone is not None and gone <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        else:
            if gone is not None:
                self.handle.registerTimer(gone)
            self.state.update(([], last, latest, gone))
        return iter(())

    def close(self) -> None:
        pass


def limiter_stream(events: DataFrame, key: str, ts: str, name: str, event_id: str, limit: int = UPLOAD_LIMIT, window_hours: float = 6.0,
                   late_after: str = "6 hours", forget_names_hours: float | None = None) -> DataFrame:
    """Streaming upload limiter (STR-1): ``key, event_id, status, uploads_left``, the batch rule with its
    state kept per key. Rows of a micro-batch are taken in time order. ``late_after`` sets the
    watermark: rows further behind the newest event of earlier micro-batches come out with the status
    ``late`` and do not change the state (``run_limiter`` puts them into a table of their own). State
    expires as in ``UploadLimiter``, at timers of the event time. Bound a micro-batch at the source
    (``maxFilesPerTrigger`` of ``stream_source``). Rows without a time are not taken."""
    # the time of the rule is computed from the watermarked column, so that Spark advances the
    # watermark by it but does not drop late rows unseen
    ev = events.where(F.col(ts).isNotNull()).withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late_after)
    ev = ev.select(F.col(key).alias("k"), F.col(event_id).alias("id"), F.col(name).cast("string").alias("nm"), micros("at").alias("us"))
    key_type, id_type = (events.schema[c].dataType.simpleString() for c in (key, event_id))
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hours = lambda h: int(h * 3600 * 1_000_000)
    forget = None if forget_names_hours is None else hours(max(forget_names_hours, window_hours))
    return ev.groupBy("k").transformWithStateInPandas(
        UploadLimiter([key, event_id], limit, hours(window_hours), forget),
        f"`{key}` {key_type}, `{event_id}` {id_type}, status string, uploads_left int", "append", "EventTime")


def run_limiter(decisions: DataFrame, sink: str, late_sink: str, checkpoint: str):
    """One incremental run: decisions to ``sink``, late rows to ``late_sink``, each below a folder
    ``epoch=N`` that a repeated epoch replaces."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        batch.where("status <> 'late'").write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        batch.where("status = 'late'").write.mode("overwrite").parquet(f"{late_sink}/epoch={epoch}")
        batch.unpersist()

    return run_batches(decisions, write, checkpoint, "append")


def run_batches(df: DataFrame, write, checkpoint: str, mode: str):
    """Process everything that has arrived by ``write(batch, epoch)``, then stop."""
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_available(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet", mode: str = "append"):
    """Process everything that has arrived, then stop (one incremental run)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return q


def chunk_stream(articles: DataFrame, width: int = K.CHUNK_WIDTH) -> DataFrame:
    """Incremental knowledge-base growth (STR-2): article rows -> chunk rows, stateless."""
    return K.chunk_documents(articles, "content", "title", "source", width, keep=["doc_id"])


def titles_stream(messages: DataFrame) -> DataFrame:
    """Live session list (STR-3): first human message and message count per session. In update mode
    an epoch gives the sessions that changed."""
    human = F.col("type") == "human"
    return messages.groupBy("session_id").agg(
        F.min_by(F.when(human, F.col("content")), F.when(human, F.col("pos"))).alias("title"),
        F.count(F.lit(1)).alias("messages"))


#: Hash buckets of a live table.
BUCKETS = 64


def _buckets_written(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> newest epoch (before ``before``) whose manifest stands: one row a bucket."""
    try:
        m = spark.read.schema("bucket int, epoch bigint").json(f"{path}/manifest")
        m = m if before is None else m.where(F.col("epoch") < before)
        return {r["bucket"]: r["epoch"] for r in m.groupBy("bucket").agg(F.max("epoch").alias("epoch")).collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}  # nothing written yet


def _live_buckets(spark: SparkSession, path: str, schema: T.StructType, at: dict[int, int]) -> DataFrame:
    paths = [f"{path}/data/epoch={e}/bucket={b}" for b, e in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_live(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The live table as of its last whole epoch."""
    return _live_buckets(spark, path, schema, _buckets_written(spark, path))


def upsert_epoch(batch: DataFrame, epoch: int, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Put the rows of ``batch`` in the place of those of equal key. Only hash buckets with a changed key
    are rewritten, below ``data/epoch=N/bucket=B``; readers see them once the epoch's manifest (one
    file) stands. A repeated epoch starts from the epochs before it and replaces what it wrote, so
    it changes nothing. Null keys are one key."""
    spark = batch.sparkSession
    batch = stored(batch, "live-changes")
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    changed = sorted(r[0] for r in batch.select(place).distinct().collect())  # at most one row a bucket
    if changed:
        before = {b: e for b, e in _buckets_written(spark, path, epoch).items() if b in set(changed)}
        old = _live_buckets(spark, path, batch.schema, before).alias("o")
        new = batch.select(F.col(key).alias("changed_key")).alias("n")
        rest = old.join(new, F.col(f"o.{key}").eqNullSafe(F.col("n.changed_key")), "left_anti")
        rows = rest.unionByName(batch).withColumn("bucket", place).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/epoch={epoch}")
        manifest = spark.createDataFrame([(b, epoch) for b in changed], "bucket int, epoch bigint").coalesce(1)
        manifest.write.mode("overwrite").json(f"{path}/manifest/epoch={epoch}")


def run_upserts(df: DataFrame, path: str, checkpoint: str, key: str, buckets: int = BUCKETS):
    """One incremental run of an aggregation in update mode: changed rows are upserted into the live
    table (``read_live``)."""
    return run_batches(df, lambda batch, epoch: upsert_epoch(batch, epoch, path, key, buckets), checkpoint, "update")


def stream_source(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                  max_files: int = 64) -> DataFrame:
    """Files of a folder as a stream, at most ``max_files`` in one micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)
