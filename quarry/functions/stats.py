"""Column statistics as distributed aggregates.

Everything per-column goes through one long (unpivoted) frame ``(column, value)`` so that a single
shuffle on ``(column, value)`` with map-side partial aggregation serves distinct counts, modes and
top-k lists for all columns at once. A hot value (one value holding a third of a column) is
pre-aggregated in every map task, so no reducer ever sees more than one row per map task for it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import stored
from quarry.types import col_of, is_float


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Spark treats NaN as a value; the reference's missing-value rules treat it as missing."""
    fl = [f.name for f in df.schema.fields if is_float(f.dataType) and (cols is None or f.name in cols)]
    if not fl:
        return df
    return df.withColumns({c: F.when(F.isnan(col_of(c)), F.lit(None)).otherwise(col_of(c)) for c in fl})


def long_values(df: DataFrame, cols: list[str], value_type: str = "string",
                keep_nulls: bool = False) -> DataFrame:
    """``cols`` as rows ``(column, value)``; values cast to ``value_type``."""
    if not cols:
        return df.sparkSession.createDataFrame([], f"column string, value {value_type}")
    out = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), col_of(c).cast(value_type).alias("value"))
                                       for c in cols])))
    return out if keep_nulls else out.filter(F.col("value").isNotNull())


def value_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value string, n bigint)`` for every non-null value of every column."""
    return long_values(df, cols, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column with their ``rank``: count desc, value asc. Each
    task cuts its own values to ``k`` before the shuffle (Spark's group limit), so no task sorts a column."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, nunique bigint)``; columns with no value get 0."""
    freq = value_frequencies(df, cols)
    counted = freq.groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(F.broadcast(counted), "column", "left") \
        .select("column", F.coalesce("nunique", F.lit(0)).cast("bigint").alias("nunique"))


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most frequent value per column, smallest value on ties: ``(column, mode)``."""
    return top_values(value_frequencies(df, cols), 1).select("column", F.col("value").alias("mode"))


#: Size of the sketches, points at which they are read, and how far (in shares of the rows) a
#: bracket reaches beyond a wanted rank on either side: about twice the sketches' error.
SKETCH_K, SKETCH_GRID, SKETCH_SLACK = 2000, 1000, 0.006


def order_statistics(df: DataFrame, ranks: dict[str, Callable[[int], set[int]]]) -> tuple[dict, dict[str, int]]:
    """``{(column, rank): value}`` and ``{column: n}``: the values of the ranks (from 0) that
    ``ranks[column](n)`` wants among a column's n non-null values in order, NaN counting as null. Ranks
    that a column does not have are left out.

    1. One pass of KLL sketches, a row of fixed size a column, brackets each wanted rank by two values.
    2. One pass counts the values below and at the ends of each bracket. Where a wanted rank falls between
       the ends, a second pass takes the values there, about a hundredth of a column; only they become rows
       and are shuffled, combined on the map side.
    3. Bracketed values are range-partitioned and totalled; running sums are taken in the ranges
       that hold a wanted rank (``_ranked``).

    A rank outside its bracket (the sketches can err) is looked for again among all values, so the result
    is exact."""
    cols = list(ranks)
    if not cols:
        return {}, {}
    x = {c: F.when(~F.isnan(col_of(c).cast("double")), col_of(c).cast("double")) for c in cols}
    grid = F.from_json(F.lit(str([i / SKETCH_GRID for i in range(SKETCH_GRID + 1)])), "array<double>")
    seen = df.agg(*[F.struct(F.count(x[c]).alias("n"), F.min(x[c]).alias("lo"), F.max(x[c]).alias("hi"),
                             F.kll_sketch_agg_double(x[c], F.lit(SKETCH_K)).alias("s")).alias(f"c{i}") for i, c in enumerate(cols)])
    # a sketch of no value has no quantiles
    read = F.transform(F.array(*[F.col(f"c{i}") for i in range(len(cols))]), lambda c: F.struct(
        c["n"].alias("n"), c["lo"].alias("lo"), c["hi"].alias("hi"), F.when(c["n"] > 0, F.kll_sketch_get_quantile_double(c["s"], grid)).alias("q")))
    at = dict(zip(cols, seen.select(read.alias("c")).first()["c"], strict=True))
    counts = {c: at[c]["n"] for c in cols}
    wanted = {(c, r) for c in cols for r in ranks[c](counts[c]) if 0 <= r < counts[c]}

    def bracket(c: str, r: int) -> tuple[float, float]:
        place, k = (r + 0.5) / at[c]["n"], SKETCH_GRID
        lo, hi = math.floor((place - SKETCH_SLACK) * k), math.ceil((place + SKETCH_SLACK) * k)
        return (at[c]["lo"] if lo <= 0 else at[c]["q"][lo]), (at[c]["hi"] if hi >= k else at[c]["q"][hi])

    found: dict = {}
    brackets = {key: bracket(*key) for key in wanted}
    while brackets:
        found |= _between(df, x, brackets)
        brackets = {(c, r): (at[c]["lo"], at[c]["hi"]) for c, r in brackets if (c, r) not in found}
    return found, counts


def _between(df: DataFrame, x: dict[str, Column], brackets: dict[tuple[str, int], tuple[float, float]]) -> dict:
    """The wanted ranks whose value lies within their bracket. Brackets of a column that overlap are one. The
    ends of a bracket are values that the counts alone settle; values between them become rows only where a
    wanted rank falls there, one row a column at most, since a column's brackets share no more than ends."""
    merged: dict[str, list[list]] = {}
    for (c, r), (lo, hi) in sorted(brackets.items(), key=lambda b: (b[0][0], b[1])):
        own = merged.setdefault(c, [])
        if own and (lo < own[-1][1] or [lo, hi] == own[-1][:2]):
            own[-1][1] = max(hi, own[-1][1])
            own[-1][2].append(r)
        else:
            own.append([lo, hi, [r]])
    flat = [(c, lo, hi, rs) for c, own in merged.items() for lo, hi, rs in own]
    at = {c: F.col(f"x{i}") for i, c in enumerate(merged)}
    values = df.select(*[x[c].alias(f"x{i}") for i, c in enumerate(merged)])
    counts = values.agg(*[F.count_if(t).alias(f"{name}{i}") for i, (c, lo, hi, _) in enumerate(flat)
                          for name, t in (("lt_lo", at[c] < lo), ("le_lo", at[c] <= lo), ("lt_hi", at[c] < hi), ("le_hi", at[c] <= hi))]).first()
    found, inside = {}, set()
    for i, (c, lo, hi, rs) in enumerate(flat):
        for r in rs:
            if counts[f"lt_lo{i}"] <= r < counts[f"le_lo{i}"]:
                found[c, r] = lo + 0.0  # no negative zero
            elif counts[f"lt_hi{i}"] <= r < counts[f"le_hi{i}"]:
                found[c, r] = hi + 0.0
            elif counts[f"le_lo{i}"] <= r < counts[f"lt_hi{i}"]:
                inside.add((i, r - counts[f"le_lo{i}"]))
    if inside:
        need: dict[str, list[tuple[int, Column]]] = {}
        for i in sorted({i for i, _ in inside}):
            c, lo, hi, _ = flat[i]
            need.setdefault(c, []).append((i, (at[c] > lo) & (at[c] < hi)))
        which = {c: F.coalesce(*[F.when(t, F.lit(i)) for i, t in tests]) for c, tests in need.items()}
        rows = values.where(reduce(or_, [t for tests in need.values() for _, t in tests])).select(
            F.inline(F.array(*[F.struct(b.alias("b"), at[c].alias("value")) for c, b in which.items()])))
        freq = stored(rows.where("b is not null").groupBy("b", "value").agg(F.count(F.lit(1)).alias("cnt")), "brackets")
        for (i, k), v in _ranked(freq, inside).items():
            found[flat[i][0], k + counts[f"le_lo{i}"]] = v
    return found


def _ranked(freq: DataFrame, wanted: set[tuple[int, int]]) -> dict:
    """``{(b, rank): value}`` of ``freq(b, value, cnt)``: values are range-partitioned, ranges totalled (one
    number per range and ``b`` in it), and running sums taken in the ranges that hold a wanted rank."""
    ranged = stored(freq.repartitionByRange("b", "value").withColumn("part", F.spark_partition_id()), "ranges")
    places, before = [], {}
    for r in ranged.groupBy("part", "b").agg(F.sum("cnt").alias("n")).orderBy("part").collect():
        start = before.get(r["b"], 0)
        before[r["b"]] = start + r["n"]
        places += [(r["part"], b, k, k - start) for b, k in wanted if b == r["b"] and start <= k < start + r["n"]]
    if not places:
        return {}
    want = F.broadcast(freq.sparkSession.createDataFrame(sorted(places), "part int, b int, rank bigint, local bigint"))  # a row a wanted rank
    w = Window.partitionBy("part", "b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.join(want.select("part", "b").distinct(), ["part", "b"], "left_semi")
    inside = inside.withColumn("end", F.sum("cnt").over(w)).withColumn("start", F.col("end") - F.col("cnt"))
    hits = inside.join(want, ["part", "b"]).filter("start <= local and local < end")
    return {(r["b"], r["rank"]): r["value"] for r in hits.select("b", "rank", "value").collect()}


def quantile_ranks(n: int, probs: list[float]) -> set[int]:
    """The ranks between which linear interpolation of the quantiles of n values takes place."""
    return {r for p in probs if n for r in (int(p * (n - 1) // 1), min(int(p * (n - 1) // 1) + 1, n - 1))}


def interpolated(n: int, p: float, value: Callable[[int], float]) -> float | None:
    """The quantile of n values given by rank (pandas / ``quantile_cont``)."""
    if not n:
        return None
    h = p * (n - 1)
    f = int(h // 1)
    a = value(f)
    return a if h == f else a + (h - f) * (value(min(f + 1, n - 1)) - a)


def quantile_map(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont``) as ``{(column, p): q}``, null for a
    column without values."""
    probs = [float(p) for p in probs]
    at, counts = order_statistics(df, {c: lambda n: quantile_ranks(n, probs) for c in cols})
    return {(c, p): interpolated(counts[c], p, lambda r: at[c, r]) for c in cols for p in probs}  # noqa: B023


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """``(column, p, q)`` from ``quantile_map`` (a small frame of ``len(cols) * len(probs)`` rows)."""
    m = quantile_map(df, cols, probs)
    return df.sparkSession.createDataFrame([(c, float(p), m[(c, float(p))]) for c in cols for p in probs],
                                           "column string, p double, q double")


def moments(df: DataFrame, cols: list[str]) -> dict:
    """Per column: count, mean, sample deviation, min, max, and the table's rows, from one aggregate."""
    if not cols:
        return {}
    x = {c: col_of(c).cast("double") for c in cols}
    row = df.agg(*[F.struct(F.count(x[c]).alias("n"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"),
                            F.min(x[c]).alias("mn"), F.max(x[c]).alias("mx")).alias(f"c{i}") for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("rows")).first()
    return {c: {**row[f"c{i}"].asDict(), "rows": row["rows"]} for i, c in enumerate(cols)}


#: Columns of a tile of the matrices of sums.
TILE = 64


def _tile_sums(starts: list[int], width: int):
    """Partial sums of one task's rows for each pair of column tiles (i <= j): over the rows that have
    both columns, how many there are, the sums of either, of their squares and of the products. Values are
    centred beforehand, gaps are NaN."""
    def run(batches):
        total: dict = {}
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns]) if b.num_rows else np.zeros((0, width))
            has = ~np.isnan(x)
            x = np.where(has, x, 0.0)
            has = has.astype(np.float64)
            cut = lambda m, a: m[:, a:a + TILE]
            for k, i in enumerate(starts):
                for j in starts[k:]:
                    xi, xj, hi, hj = cut(x, i), cut(x, j), cut(has, i), cut(has, j)
                    now = np.stack([hi.T @ hj, xi.T @ hj, hi.T @ xj, (xi * xi).T @ hj, hi.T @ (xj * xj), xi.T @ xj])
                    total[i, j] = total[i, j] + now if (i, j) in total else now
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array([i for i, _ in total], pa.int32()), "j": pa.array([j for _, j in total], pa.int32()),
                                              "sums": pa.array([m.tobytes() for m in total.values()], pa.binary())})

    return run


def _add_tiles(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column("sums"):
            m = np.frombuffer(raw.as_buffer())
            total = m.copy() if total is None else total + m
    yield pa.RecordBatch.from_pydict({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()),
                                      "sums": pa.array([total.tobytes()], pa.binary())})


def corr_pairs(df: DataFrame, cols: list[str]) -> dict:
    """Pearson correlation of every pair (a <= b) over pairwise-complete rows, ``{(a, b): r}``; null when
    either side is constant over those rows or fewer than 2 rows remain.

    Two passes: means, then sums of mean-centred values and products as matrices of column tiles, one
    partial matrix a task and tile, added up in two steps (groups of tasks, then all). The plan has one
    expression a column; the driver gets one number a pair and sum."""
    if not cols:
        return {}
    m = moments(df, cols)
    centred = df.select(*[(col_of(c).cast("double") - F.lit(float(m[c]["mean"] or 0.0))).alias(f"x{i}") for i, c in enumerate(cols)])
    starts = list(range(0, len(cols), TILE))
    schema = "i int, j int, sums binary"
    parts = centred.mapInArrow(_tile_sums(starts, len(cols)), schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(32)))
    some = parts.groupBy("i", "j", "group").applyInArrow(_add_tiles, schema)
    out = {}
    for r in some.groupBy("i", "j").applyInArrow(_add_tiles, schema).collect():
        i, j = r["i"], r["j"]
        a, b = cols[i:i + TILE], cols[j:j + TILE]
        n, sx, sy, sxx, syy, sxy = np.frombuffer(r["sums"]).reshape(6, len(a), len(b))
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy, both = sxx - sx * sx / n, syy - sy * sy / n, sxy - sx * sy / n
            # what centring leaves of a constant is rounding
            flat = (n < 2) | (vx <= 1e-14 * sxx) | (vy <= 1e-14 * syy)
            cor = both / np.sqrt(vx * vy)
        for p, ca in enumerate(a):
            for q, cb in enumerate(b):
                if i < j or p <= q:
                    constant = m[ca]["mn"] == m[ca]["mx"] or m[cb]["mn"] == m[cb]["mx"]
                    out[ca, cb] = None if flat[p, q] or constant else float(cor[p, q])
    return {(a, b): out.get((a, b)) for k, a in enumerate(cols) for b in cols[k:]}


def sample_skew(c: Column, n: Column, vmin: Column, vmax: Column) -> Column:
    """Bias-corrected skewness G1 from Spark's population ``skewness``; 0 for a constant column,
    null below 3 values."""
    g1 = F.skewness(c)
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(vmin == vmax, F.lit(0.0)).otherwise(adj)


def sample_kurtosis(c: Column, n: Column, vmin: Column, vmax: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population ``kurtosis``; 0 for a constant
    column, null below 4 values."""
    g2 = F.kurtosis(c)
    adj = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(vmin == vmax, F.lit(0.0)).otherwise(adj)
