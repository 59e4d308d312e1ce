"""Upload limiter over whole histories (CNV-14, CNV-15, CNV-16), also for a user with a third of all rows.

The rule is sequential in a key: its state is at most ``limit`` accepted times and the last accepted
name. Rows are dealt by ranges of (key, time, id), so a busy key spreads over many tasks, and each
task walks its range once with constant state:

* Keys that begin inside a range start from the empty state: their rows are final.
* The range's first key may go on from the range before. Its *head*, up to the first pause of a whole
  window, depends on the state there and is left open. Behind the pause all accepted times have
  expired, so only the last name matters, and only whether it equals the first name behind the pause:
  the rest of the key in this range is walked for both cases, a function of one bit.

The open heads (ranges without a pause are heads throughout, and make one run with the next head) are
walked again from the at most two states that the range before can end in. One small row a range
then tells which case holds everywhere, composed from range to range.

A key that never pauses for a window stays one run and is walked in order by one task: nothing less
than the order itself decides there.
"""

from __future__ import annotations

import json
import pickle

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import stored

# Limit and window of uploads.
UPLOAD_LIMIT = 3
UPLOAD_WINDOW_HOURS = 6.0

FINAL, HEAD, REST = 0, 1, 2
#: No upload's name.
_OTHER = object()
_NONE_YET = object()


def micros(col_name: str) -> Column:
    """Microseconds since the epoch of a timestamp column, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                  f"cast(`{col_name}` as timestamp_ntz))")


def limit_step(kept: list, last, t: int, name, limit: int, window_us: int):
    """The limiter's rule for one upload: (accepted times, last accepted name, status). Batch and
    stream share it."""
    kept = [x for x in kept if x > t - window_us]
    if len(kept) >= limit:
        return kept, last, "refused"
    if name == last:
        return kept, last, "repeat"
    return [*kept, t], name, "accepted"


class _Walk:
    """The rule from one state on. Rows without a time have no status and change nothing."""

    def __init__(self, state, limit: int, window_us: int):
        self.kept, self.last = state
        self.limit, self.window_us = limit, window_us

    def step(self, t, name) -> tuple[str | None, int | None]:
        if t is None:
            return None, None
        self.kept, self.last, status = limit_step(self.kept, self.last, t, name, self.limit, self.window_us)
        return status, max(0, self.limit - len(self.kept))

    @property
    def state(self):
        return self.kept, self.last


class _Rows:
    """Statuses of one batch's rows, one or two cases each."""

    def __init__(self):
        self.kind, self.case = [], ([], [], [], [])

    def add(self, kind: int, walks: list[_Walk], t, name) -> None:
        self.kind.append(kind)
        for c in (0, 1):
            status, left = walks[c].step(t, name) if c < len(walks) else (None, None)
            self.case[2 * c].append(status)
            self.case[2 * c + 1].append(left)

    def arrays(self) -> list[pa.Array]:
        return [pa.array(x, kind) for x, kind in zip(self.case, (pa.string(), pa.int32()) * 2, strict=True)]


def _edge(names: list[str], types: list[pa.DataType], what: dict) -> pa.RecordBatch:
    """A row that carries what a range tells the others."""
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:-1]), pa.array([pickle.dumps(what)], pa.binary())], names=names)


def _ranges(names: list[str], at: tuple[int, int, int], limit: int, window_us: int):
    """First pass: rows of a range, sorted by (key, time, id)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        first = key = _NONE_YET
        kind, walks, before, types = HEAD, [], None, None
        told = {"part": part, "rest": None, "end": None}
        for b in batches:
            if not b.num_rows:
                continue
            out = _Rows()
            for k, t, name in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if key is _NONE_YET:
                    first = key = k
                elif k != key:
                    if kind == REST:
                        told["rest"] = (told["rest"], *(w.state for w in walks))
                    key, kind, walks, before = k, FINAL, [_Walk(([], None), limit, window_us)], None
                if kind == HEAD and t is not None and before is not None and t - before >= window_us:
                    kind, told["rest"] = REST, name
                    walks = [_Walk(([], x), limit, window_us) for x in (name, _OTHER)]
                    told["paused"] = True
                before = before if t is None else t
                out.add(kind, walks, t, name)
            n = b.num_rows
            arrays = [*b.columns, pa.array([part] * n, pa.int32()), pa.array(out.kind, pa.int32()), *out.arrays(), pa.nulls(n, pa.binary())]
            types = [a.type for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        if key is _NONE_YET:
            return
        if kind == REST:
            told["rest"] = (told["rest"], *(w.state for w in walks))
        if kind == FINAL:
            told["end"] = walks[0].state
        yield _edge(names, types, {**told, "first": first, "last": key, "paused": told.get("paused", False)})

    return run


def _heads(names: list[str], at: tuple[int, int, int], starts: dict, limit: int, window_us: int):
    """Second pass: open rows sorted by (run, time, id), from the states that the run can start in."""

    def run(batches):
        now, walks, types = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            out, ends = _Rows(), []
            for r, t, name in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                if r != now:
                    if now is not None:
                        ends.append({"run": now, "names": [w.last for w in walks]})
                    now, walks = r, [_Walk(s, limit, window_us) for s in starts[r]]
                out.add(HEAD, walks, t, name)
            arrays = [*b.columns, *out.arrays(), pa.nulls(b.num_rows, pa.binary())]
            types = [a.type for a in arrays]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            for e in ends:
                yield _edge(names, types, e)
        if now is not None:
            yield _edge(names, types, {"run": now, "names": [w.last for w in walks]})

    return run


def _runs(edges: list[dict]) -> tuple[dict, dict, dict]:
    """From the ranges' rows, in order: the run of each range's head, the states in which a run can
    start, and the range whose case decides between two of them."""
    run_of, starts, decided_by, before = {}, {}, {}, None
    for e in edges:
        goes_on = before is not None and before["last"] == e["first"]
        open_ = goes_on and before["first"] == before["last"]
        if open_ and not before["paused"]:
            run_of[e["part"]] = run_of[before["part"]]
        else:
            run = run_of[e["part"]] = e["part"]
            if open_:
                starts[run], decided_by[run] = list(before["rest"][1:]), before["part"]
            else:
                starts[run] = [before["end"] if goes_on else ([], None)]
        before = e
    return run_of, starts, decided_by


def _cases(edges: list[dict], run_of: dict, decided_by: dict, last_names: dict) -> tuple[list[int], list[int]]:
    """Ranges behind whose pause, and runs for which, the second case holds."""
    second: set[int] = set()
    runs: set[int] = set()
    for e in edges:
        run = run_of[e["part"]]
        if decided_by.get(run) in second:
            runs.add(run)
        if e["paused"] and last_names[run][int(run in runs)] != e["rest"][0]:
            second.add(e["part"])
    return sorted(second), sorted(runs)


def _told(df: DataFrame, edge: str) -> list[dict]:
    """One row for each range or run."""
    return [pickle.loads(r[0]) for r in df.where(F.col(edge).isNotNull()).select(edge).collect()]  # noqa: S301  written by the pass above


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def rate_limit(uploads: DataFrame, key: str = "session_id", ts: str = "ts", name: str = "name", event_id: str = "event_id",
               limit: int = UPLOAD_LIMIT, window_hours: float = UPLOAD_WINDOW_HOURS, partitions: int | None = None) -> DataFrame:
    """Upload limiter (CNV-14, CNV-16): per key, in the order of (time, id), forget accepted uploads of an
    age of the window or more; refuse while ``limit`` accepted ones remain; the same name as the last
    accepted upload is a repeat, not a new upload. Returns the input columns plus ``status`` and
    ``uploads_left``; rows without a time have null there. Null keys are one key.

    Plan: one range shuffle and one walk over all rows, written once; a second shuffle moves open heads
    only. At most ``partitions`` small rows come to the driver."""
    if limit < 1:
        raise ValueError("the limit is at least 1")
    cols = uploads.columns
    us, part, kind, s0, l0, s1, l1, edge, run = (_free(x, cols) for x in ("us", "part", "kind", "s0", "l0", "s1", "l1", "edge", "run"))
    window_us = int(window_hours * 3600 * 1_000_000)
    n = partitions or int(uploads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = uploads.withColumn(us, micros(ts))
    order = [key, us, event_id]
    names = [*rows.columns, part, kind, s0, l0, s1, l1, edge]
    cases = [T.StructField(s0, T.StringType()), T.StructField(l0, T.IntegerType()), T.StructField(s1, T.StringType()), T.StructField(l1, T.IntegerType()),
             T.StructField(edge, T.BinaryType())]
    own = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    schema = T.StructType([*own, T.StructField(part, T.IntegerType()), T.StructField(kind, T.IntegerType()), *cases])
    at = tuple(rows.columns.index(c) for c in (key, us, name))
    walked = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_ranges(names, at, limit, window_us), schema), "limiter")
    edges = sorted(_told(walked, edge), key=lambda e: e["part"])
    run_of, starts, decided_by = _runs(edges)

    by_part = F.from_json(F.lit(json.dumps([run_of.get(p, p) for p in range(max(run_of, default=0) + 1)])), "array<int>")
    run_col = F.get(by_part, F.col(part))
    opened = walked.where(F.col(kind) == HEAD).withColumn(run, run_col).select(*rows.columns, run)
    opened = opened.repartition(max(1, min(n, len(starts))), run).sortWithinPartitions(run, us, event_id)
    schema = T.StructType([*own, T.StructField(run, T.IntegerType()), *cases])
    names = [*rows.columns, run, s0, l0, s1, l1, edge]
    at = (len(names) - 6, rows.columns.index(us), rows.columns.index(name))
    heads = stored(opened.mapInArrow(_heads(names, at, starts, limit, window_us), schema), "limiter-heads")
    second, runs = _cases(edges, run_of, decided_by, {e["run"]: e["names"] for e in _told(heads, edge)})

    def result(df: DataFrame, other: Column) -> DataFrame:
        pick = lambda a, b: F.when(other, F.col(b)).otherwise(F.col(a))
        return df.where(F.col(edge).isNull()).select(*cols, pick(s0, s1).alias("status"), pick(l0, l1).alias("uploads_left"))

    done = walked.where(F.col(kind).isin(FINAL, REST))
    return result(done, (F.col(kind) == REST) & F.col(part).isin(second)).unionByName(result(heads, F.col(run).isin(runs)))


def drop_repeats(uploads: DataFrame, key: str, ts: str, name: str, tiebreak: str, limit: int = UPLOAD_LIMIT,
                 window_hours: float = UPLOAD_WINDOW_HOURS) -> DataFrame:
    """``is_new``: the limiter accepted the upload, that is, its name differs from the last accepted
    one and there was room (CNV-15). From the same walk as ``rate_limit``."""
    out = rate_limit(uploads, key, ts, name, tiebreak, limit, window_hours)
    return out.withColumn("is_new", F.col("status") == "accepted").drop("status", "uploads_left")
