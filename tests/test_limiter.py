"""The limiter over ranges against the sequential rule, key by key."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.operators import limiter as L

SCHEMA = "event_id long, user string, ts timestamp_ntz, name string, part string, kind int"
T0 = dt.datetime(2024, 1, 1)


def uploads(seed, gap_minutes, users=12, n=1500, hot=0.34):
    """A hot user with a third of all rows; pauses of a window now and then."""
    r = random.Random(seed)
    clock, rows = defaultdict(int), []
    for i in range(n):
        u = "hot" if r.random() < hot else f"u{r.randrange(users)}"
        clock[u] += r.choice([0, 0, 1, 7, 60, 180, gap_minutes])
        rows.append((i, u, T0 + dt.timedelta(minutes=clock[u]), r.choice(["a", "a", "b", "c", None]), "x", 1))
    rows += [(n + 1, None, T0, "a", "x", 1), (n + 2, None, T0, "a", "x", 1), (n + 3, "hot", None, "a", "x", 1), (n + 4, "u1", None, "b", "x", 1)]
    r.shuffle(rows)
    return rows


def sequential(rows):
    by = defaultdict(list)
    for i, u, t, name, *_ in rows:
        by[u].append((t or T0 - dt.timedelta(days=1), i, t, name))
    out = {}
    for seen in by.values():
        kept, last = [], None
        for _, i, t, name in sorted(seen, key=lambda x: x[:2]):
            if t is None:
                out[i] = (None, None)
                continue
            us = round((t - T0).total_seconds() * 1e6)
            kept, last, status = L.limit_step(kept, last, us, name, 3, 6 * 3600 * 10**6)
            out[i] = (status, max(0, 3 - len(kept)))
    return out


@pytest.mark.parametrize(("seed", "gap", "partitions"), [(1, 400, 1), (2, 400, 16), (3, 2000, 40), (4, 30, 16), (5, 360, 23)])
def test_equals_sequential_rule(spark, seed, gap, partitions):
    rows = uploads(seed, gap)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = L.rate_limit(df, "user", partitions=partitions)
    assert out.columns == [*df.columns, "status", "uploads_left"]
    got = {r["event_id"]: (r["status"], r["uploads_left"]) for r in out.collect()}
    assert got == sequential(rows)
    assert {s for s, _ in got.values()} >= {"accepted", "repeat", "refused"}
    assert L.rate_limit(df.limit(0), "user", partitions=partitions).count() == 0


def test_hot_user_spreads(spark, monkeypatch):
    """A third of all rows in one key: no task gets more than a range, and few rows move again."""
    seen = {}
    monkeypatch.setattr(L, "stored", lambda df, name, keep=L.stored: seen.setdefault(name, keep(df, name)))
    rows = uploads(9, 500, n=3000)
    L.rate_limit(spark.createDataFrame(rows, SCHEMA), "user", partitions=24).count()
    walked = seen["limiter"].where(F.col("edge").isNull())
    hot = Counter(r["part_"] for r in walked.where("user = 'hot'").collect())
    assert len(hot) >= 7 and max(Counter(r["part_"] for r in walked.collect()).values()) < 3 * len(rows) / 24
    assert seen["limiter-heads"].where(F.col("edge").isNull()).count() < len(rows) / 5


def test_no_pause_is_one_run(spark):
    rows = [(i, "u", T0 + dt.timedelta(minutes=11 * i), "abc"[i * i % 3], "x", 1) for i in range(700)] + [(900, "v", T0, "a", "x", 1)]
    got = {r["event_id"]: (r["status"], r["uploads_left"]) for r in L.rate_limit(spark.createDataFrame(rows, SCHEMA), "user", partitions=9).collect()}
    assert got == sequential(rows)
