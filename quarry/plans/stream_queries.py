"""Streaming queries: data arrives in time-ordered slices (written as separate appends to a shared
folder), each slice is processed by one incremental run of the same streaming query, and the
sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import conversation as cnv
from quarry.plans.conversation_queries import LIMIT_SQL, MSGS
from quarry.plans.kb_queries import DIGEST_SQL, chunk_sql, digests
from quarry.plans.registry import Tables, query
from quarry.sources.files import scratch_path
from quarry.streaming import streams as ST

SLICES = ["2024-01-11", "2024-01-21"]  # events arrive in three slices split at these dates


EVENT_COLS = ["event_id", "user_id", "ts", "event_type"]


def _limited(spark, slices):
    """Each slice arrives, then one incremental run; (decisions, late rows)."""
    inbox, out, late, ck = (scratch_path(spark, n) for n in ("limit-in", "limit-out", "limit-late", "limit-ck"))
    for rows in slices:
        rows.write.mode("append").parquet(inbox)
        src = ST.stream_source(spark, inbox, rows.schema)
        ST.run_limiter(ST.limiter_stream(src, "user_id", "ts", "event_type", "event_id", late_after="1 hour"), out, late, ck)
    return spark.read.parquet(out).drop("epoch"), spark.read.parquet(late).drop("epoch")


@query("stream_rate_limit", LIMIT_SQL + """SELECT event_id, user_id, status,
  CAST(greatest(0, 3 - len(kept)) AS INTEGER) AS uploads_left FROM r""")
def q_stream_rate_limit(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select(EVENT_COLS)
    ts = F.col("ts")
    bounds = [F.lit(d).cast("timestamp_ntz") for d in SLICES]
    decided, _ = _limited(spark, [e.filter(ts < bounds[0]), e.filter((ts >= bounds[0]) & (ts < bounds[1])), e.filter(ts >= bounds[1])])
    return decided.select("event_id", "user_id", "status", "uploads_left")


@query("stream_late", f"""WITH arrived AS (
  SELECT event_id, user_id, ts, (ts >= TIMESTAMP '{SLICES[0]}')::INT + (ts >= TIMESTAMP '{SLICES[1]}')::INT + (event_id % 10 = 0)::INT AS slice FROM events),
seen AS (SELECT slice + 1 AS slice, max(ts) AS newest FROM arrived GROUP BY 1),
mark AS (SELECT slice, date_trunc('milliseconds', max(newest) OVER (ORDER BY slice)) - INTERVAL 1 HOUR AS mark FROM seen)
SELECT event_id, user_id FROM arrived JOIN mark USING (slice) WHERE ts < mark""")
def q_stream_late(spark, sf_dir):
    """Every tenth event arrives a slice later than the others of its time; those that are more than an
    hour behind what came before are in the table of late rows."""
    ts = F.col("ts")
    bounds = [F.lit(d).cast("timestamp_ntz") for d in SLICES]
    e = Tables(spark, sf_dir).events.select(EVENT_COLS)
    arrives = sum(((ts >= b).cast("int") for b in bounds), F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    _, late = _limited(spark, [e.where(arrives == k) for k in range(4)])
    return late.select("event_id", "user_id")


@query("stream_chunks", chunk_sql() + DIGEST_SQL)
def q_stream_chunks(spark, sf_dir):
    """Articles arrive as JSON files in two slices; each run appends their chunks to the
    knowledge base; every document's chunks are those of the batch rule."""
    d = Tables(spark, sf_dir).documents.select(
        "doc_id", F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), "source")
    inbox, out, ck = (scratch_path(spark, n) for n in ("articles-in", "kb-out", "kb-ck"))
    for cond in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1):  # two arrival slices, all rows
        d.filter(cond).write.mode("append").json(inbox)
        src = ST.stream_source(spark, inbox, d.schema, "json")
        ST.run_available(ST.chunk_stream(src), out, ck)
    return digests(spark.read.parquet(out))


@query("stream_titles", f"""WITH {MSGS}
SELECT session_id, arg_min(content, pos) FILTER (WHERE type = 'human') AS title, count(*) AS messages
FROM msgs GROUP BY session_id""")
def q_stream_titles(spark, sf_dir):
    m = cnv.messages_from_log(Tables(spark, sf_dir).conversations).drop("file")
    inbox, out, ck = (scratch_path(spark, n) for n in ("msgs-in", "titles-out", "titles-ck"))
    for cond in (F.col("pos") < 2, F.col("pos") >= 2):  # early turns arrive first
        m.filter(cond).write.mode("append").parquet(inbox)
        src = ST.stream_source(spark, inbox, m.schema)
        live = ST.titles_stream(src)
        ST.run_upserts(live, out, ck, "session_id")
    return ST.read_live(spark, out, live.schema)
