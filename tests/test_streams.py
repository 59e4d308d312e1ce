"""The streaming limiter equals the batch rule when arrivals within a micro-batch are out of
time order."""

import datetime as dt
import random
import tempfile

from quarry.operators.conversation import rate_limit
from quarry.streaming import streams as ST


def test_stream_limiter_equals_batch_on_shuffled_arrivals(spark):
    random.seed(1)
    t0 = dt.datetime(2024, 1, 1)
    ev = [(i, "u%d" % (i % 3), t0 + dt.timedelta(minutes=random.randint(0, 2000)), random.choice("abc"))
          for i in range(300)]
    random.shuffle(ev)
    df = spark.createDataFrame(ev, "event_id long, session_id string, ts timestamp_ntz, name string")
    d = tempfile.mkdtemp(prefix="quarry-stream-test-")
    df.write.parquet(d + "/in")
    src = ST.stream_source(spark, d + "/in", df.schema)
    ST.run_available(ST.limiter_stream(src, "session_id", "ts", "name", "event_id"), d + "/out", d + "/ck")
    got = {r["event_id"]: (r["status"], r["uploads_left"]) for r in spark.read.parquet(d + "/out").collect()}
    exp = {r["event_id"]: (r["status"], r["uploads_left"]) for r in rate_limit(df).collect()}
    assert got == exp


def test_stream_limiter_marks_late_rows(spark):
    t0 = dt.datetime(2024, 1, 1)
    d = tempfile.mkdtemp(prefix="quarry-stream-test-")
    schema = "event_id long, session_id string, ts timestamp_ntz, name string"
    for part in ([(1, "u", t0 + dt.timedelta(hours=60), "a")], [(2, "u", t0, "b"), (3, "u", t0 + dt.timedelta(hours=60, minutes=1), "c")],
                 [(4, "u", t0 + dt.timedelta(minutes=5), "d"), (5, "u", t0 + dt.timedelta(hours=60, minutes=2), "e")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(d + "/in")
        src = ST.stream_source(spark, d + "/in", spark.read.parquet(d + "/in").schema)
        ST.run_available(ST.limiter_stream(src, "session_id", "ts", "name", "event_id", late_after="1 hour"), d + "/out", d + "/ck")
    got = {r["event_id"]: r["status"] for r in spark.read.parquet(d + "/out").collect()}
    assert got == {1: "accepted", 2: "late", 3: "accepted", 4: "late", 5: "accepted"}


EVENT = "event_id long, session_id string, ts timestamp_ntz, name string"
T0 = dt.datetime(2024, 1, 1)


def _arrive(spark, d, rows, **options):
    """Rows arrive, then one run; decisions and late rows so far."""
    spark.createDataFrame([(i, k, T0 + dt.timedelta(hours=h), n) for i, k, h, n in rows], EVENT).coalesce(1).write.mode("append").parquet(d + "/in")
    src = ST.stream_source(spark, d + "/in", spark.read.parquet(d + "/in").schema)
    ST.run_limiter(ST.limiter_stream(src, "session_id", "ts", "name", "event_id", late_after="1 hour", **options), d + "/out", d + "/late", d + "/ck")
    got = {r["event_id"]: r["status"] for r in spark.read.parquet(d + "/out").collect()}
    return got, {r["event_id"] for r in spark.read.parquet(d + "/late").collect()}


def _state(spark, d):
    rows = spark.read.format("statestore").option("stateVarName", "limiter").load(d + "/ck").collect()
    return {r["key"]["k"]: r["value"] for r in rows}


def test_limiter_state_expires(spark):
    d = tempfile.mkdtemp(prefix="quarry-stream-test-")
    _arrive(spark, d, [(1, "u", 0, "a"), (2, "u", 0.5, "b"), (3, "v", 3, "a")])
    assert len(_state(spark, d)["u"]["kept"]) == 2
    _arrive(spark, d, [(4, "w", 9, "x")])  # the watermark passes 6 h behind u's newest event, not v's
    _arrive(spark, d, [(5, "w", 9.1, "y")])
    state = _state(spark, d)
    assert list(state["u"]["kept"]) == [] and state["u"]["last"] == "b" and len(state["v"]["kept"]) == 1
    got, late = _arrive(spark, d, [(6, "u", 9.2, "b"), (7, "u", 9.3, "c"), (8, "u", 0.1, "z")])
    assert got == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted", 5: "accepted", 6: "repeat", 7: "accepted"} and late == {8}


def test_limiter_forgets_names(spark):
    d = tempfile.mkdtemp(prefix="quarry-stream-test-")
    for rows in ([(1, "u", 0, "a"), (2, "v", 0, "a")], [(3, "w", 30, "x")], [(4, "w", 60, "x")], [(5, "w", 90, "x")]):
        _arrive(spark, d, rows, forget_names_hours=24)
    assert set(_state(spark, d)) == {"w"}
    got, _ = _arrive(spark, d, [(6, "u", 91, "a")], forget_names_hours=24)
    assert got[6] == "accepted"


def test_upserts_by_epoch(spark):
    import glob
    import shutil

    d = tempfile.mkdtemp(prefix="quarry-live-test-")
    schema = spark.createDataFrame([], "session_id string, title string, messages long").schema
    batch = lambda rows: spark.createDataFrame(rows, schema)
    read = lambda: sorted(((r["session_id"] or "", r["title"], r["messages"]) for r in ST.read_live(spark, d, schema).collect()))
    assert read() == []
    ST.upsert_epoch(batch([(f"s{i}", "t", 1) for i in range(40)] + [(None, "n", 1)]), 0, d, "session_id", 8)
    ST.upsert_epoch(batch([("s3", "new", 2), ("new", "t", 1)]), 1, d, "session_id", 8)
    want = sorted([(f"s{i}", "new" if i == 3 else "t", 2 if i == 3 else 1) for i in range(40)] + [("", "n", 1), ("new", "t", 1)])
    assert read() == want
    assert len(glob.glob(d + "/data/epoch=1/bucket=*")) <= 2  # only buckets of changed keys
    ST.upsert_epoch(batch([("s3", "new", 2), ("new", "t", 1)]), 1, d, "session_id", 8)  # the epoch runs again
    ST.upsert_epoch(batch([]), 2, d, "session_id", 8)
    assert read() == want
    ST.upsert_epoch(batch([("s5", "torn", 9), (None, "m", 2)]), 3, d, "session_id", 8)
    whole = read()
    shutil.copytree(d, d + "-torn")
    for f in glob.glob(d + "-torn/manifest/epoch=3/part-*"):  # stopped before its manifest stood
        open(f, "w").close()
    torn = sorted(((r["session_id"] or "", r["title"], r["messages"]) for r in ST.read_live(spark, d + "-torn", schema).collect()))
    assert torn == want and ("s5", "torn", 9) in whole and ("", "m", 2) in whole and len(whole) == len(want)
