"""Chart data (aggregates only; drawing is left to the client).

Every chart is computed from whole columns: histograms, box statistics, kernel densities and 2-D
bin counts are single aggregates; top-k lists come from the shared long-format frequencies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import stats as S
from quarry.operators import profile as P
from quarry.types import col_of, numeric_cols, text_cols

# How many columns each chart of the app takes, in schema order (callers pass such a
# slice; the functions take all columns), and its top-k.
HIST_COLS, BOX_COLS, BAR_COLS, VIOLIN_COLS, PIE_COLS = 6, 5, 4, 5, 2
BAR_TOP, PIE_TOP = 10, 6


def overview(df: DataFrame) -> DataFrame:
    """Cells, rows, columns and columns per type as ``(metric, value)`` (VIZ-1)."""
    m = P.table_metrics(df)
    shape = m.select(F.explode(F.array(
        F.struct(F.lit("cells").alias("metric"), (F.col("rows") * F.col("columns")).alias("value")),
        F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")),
        F.struct(F.lit("columns").alias("metric"), F.col("columns").alias("value")))).alias("x")).select("x.*")
    types = P.dtype_counts(df).select(F.concat(F.lit("type:"), "data_type").alias("metric"),
                                      F.col("columns").alias("value"))
    return shape.unionByName(types)


def histogram(df: DataFrame, cols: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width bin counts over [min, max] of numeric columns (VIZ-3); empty bins are listed with
    count 0. ``(column, bin, lo, hi, count)``."""
    cols = cols if cols is not None else numeric_cols(df)
    d = S.nan_to_null(df, cols)
    spark = df.sparkSession
    rng = S.moments(d, cols)  # min/max per column
    cols = [c for c in cols if rng[c]["mn"] is not None]
    if not cols:
        return spark.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    parts = [F.when(col_of(c).isNotNull(), F.struct(F.lit(c).alias("column"), _bin(c, rng[c], bins).alias("bin"))) for c in cols]
    counted = d.select(F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")) \
        .groupBy("x.column", "x.bin").agg(F.count(F.lit(1)).alias("count"))
    edges = spark.createDataFrame(
        [(c, i, rng[c]["mn"] + i * ((rng[c]["mx"] - rng[c]["mn"]) / bins),
          rng[c]["mn"] + (i + 1) * ((rng[c]["mx"] - rng[c]["mn"]) / bins))
         for c in cols for i in range(bins)], "column string, bin int, lo double, hi double")
    return edges.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _bin(c: str, m: dict, bins: int) -> Column:
    width = (m["mx"] - m["mn"]) / bins if m["mx"] > m["mn"] else 1.0
    return F.least(F.lit(bins - 1), F.floor((col_of(c).cast("double") - F.lit(m["mn"])) / F.lit(width))).cast("int")


BOX_SCHEMA = ("column string, q1 double, median double, q3 double, lower_fence double, upper_fence double, "
              "whisker_low double, whisker_high double, mean double, outliers bigint")


def box_stats(df: DataFrame, cols: list[str] | None = None, k: float = 1.5) -> DataFrame:
    """Quartiles, fences, whiskers (extreme values inside the fences) and outlier counts of numeric
    columns (VIZ-4)."""
    cols = cols if cols is not None else numeric_cols(df)
    d = S.nan_to_null(df, cols)
    q = S.quantile_map(d, cols, [0.25, 0.5, 0.75])
    rows = []
    for c in cols:
        q1, med, q3 = (q[(c, p)] for p in (0.25, 0.5, 0.75))
        if q1 is not None:
            rows.append((c, q1, med, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1)))
    if not rows:
        return df.sparkSession.createDataFrame([], BOX_SCHEMA)
    parts = []
    for i, (c, _, _, _, lo, hi) in enumerate(rows):
        x = col_of(c).cast("double")
        inside = (x >= lo) & (x <= hi)
        parts.append(F.struct(F.min(F.when(inside, x)).alias("wl"), F.max(F.when(inside, x)).alias("wh"),
                              F.count_if(x.isNotNull() & ~inside).cast("bigint").alias("o"), F.avg(x).alias("m")).alias(f"c{i}"))
    agg = d.agg(*parts).first()
    return df.sparkSession.createDataFrame(
        [(*r, agg[f"c{i}"]["wl"], agg[f"c{i}"]["wh"], agg[f"c{i}"]["m"], agg[f"c{i}"]["o"]) for i, r in enumerate(rows)], BOX_SCHEMA)


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = BAR_TOP) -> DataFrame:
    """Bars: top ``k`` values of text columns (VIZ-5)."""
    cols = cols if cols is not None else text_cols(df)
    return P.value_counts(df, cols, k)


def pie(df: DataFrame, cols: list[str] | None = None, k: int = PIE_TOP) -> DataFrame:
    """Pie slices: top ``k`` values of text columns; shares are of the ``k`` shown (VIZ-8)."""
    cols = cols if cols is not None else text_cols(df)
    top = P.value_counts(df, cols, k)
    tot = top.groupBy("column").agg(F.sum("count").alias("_t"))
    return top.join(tot, "column").select("column", "value", "count", "rank",
                                          (F.col("count") / F.col("_t")).alias("share"))


def silverman_bandwidth(std: float, iqr: float, n: int) -> float:
    """Rule-of-thumb kernel width: 1.059 * min(std, iqr / 1.349) * n^(-1/5) (std alone when the
    IQR is 0)."""
    s = min(std, iqr / 1.349) if iqr > 0 else std
    return 1.059 * s * n ** (-0.2)


def _kde_partials(specs: list[tuple[str, float, float, float]], grid: int):
    """Per-partition Gaussian kernel sums on the grid, vectorised with numpy over (column number,
    value, count) rows; ``specs`` holds (column, grid start, grid step, bandwidth). Emits one row per
    (column, point) per partition."""
    import numpy as np
    import pandas as pd

    def run(batches):
        acc = np.zeros((len(specs), grid))
        for pdf in batches:
            for i, g in pdf.groupby("i"):
                _, lo, step, h = specs[i]
                x, n = g["value"].to_numpy(), g["cnt"].to_numpy(dtype=np.float64)
                points = lo + step * np.arange(grid)
                for at in range(0, len(x), 4096):  # bounded (4096 x grid) block
                    z = (x[at:at + 4096, None] - points[None, :]) / h
                    acc[i] += n[at:at + 4096] @ np.exp(-0.5 * z * z)
        i, point = np.meshgrid(np.arange(len(specs)), np.arange(grid), indexing="ij")
        yield pd.DataFrame({"i": i.ravel(), "point": point.ravel(), "s": acc.ravel()})

    return run


def violin(df: DataFrame, cols: list[str] | None = None, grid: int = 64) -> DataFrame:
    """Gaussian kernel density on ``grid`` points spanning [min - 2h, max + 2h] of numeric columns
    (VIZ-7); the inner box and mean line come from ``box_stats``. Exact: equal values are counted
    first (combined on the map side), every distinct value contributes to every grid point, summed
    per partition in numpy, then one small shuffle of (column, point) partial sums."""
    cols = cols if cols is not None else numeric_cols(df)
    d = S.nan_to_null(df, cols)
    base, q = S.moments(d, cols), S.quantile_map(d, cols, [0.25, 0.75])
    specs, meta = [], []
    for c in cols:
        s = base[c]
        if not s["n"] or s["n"] < 2 or not s["std"]:
            continue
        h = silverman_bandwidth(s["std"], q[(c, 0.75)] - q[(c, 0.25)], s["n"])
        if h <= 0:
            continue
        lo, hi = s["mn"] - 2 * h, s["mx"] + 2 * h
        step = (hi - lo) / (grid - 1)
        meta.append((len(specs), c, lo, step, 1.0 / (s["n"] * h * math.sqrt(2 * math.pi))))
        specs.append((c, lo, step, h))
    spark = df.sparkSession
    if not specs:
        return spark.createDataFrame([], "column string, point int, x double, density double")
    m = spark.createDataFrame(meta, "i int, column string, lo double, step double, norm double")
    freq = S.long_values(d, [c for c, *_ in specs], "double").groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    parts = freq.join(F.broadcast(m.select("i", "column")), "column").select("i", "value", "cnt") \
        .mapInPandas(_kde_partials(specs, grid), "i int, point int, s double")
    sums = parts.groupBy("i", "point").agg(F.sum("s").alias("s"))
    return sums.join(F.broadcast(m), "i").select(  # one row per column: a bounded broadcast
        "column", "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"), (F.col("s") * F.col("norm")).alias("density"))


def scatter_density(df: DataFrame, cols: list[str] | None = None, bins: int = 20) -> DataFrame:
    """Scatter matrix as exact 2-D bin counts for every pair of numeric columns (VIZ-6 over all
    rows): ``(a, b, bin_a, bin_b, count)``, pairwise complete rows only. Each task counts every pair
    of its rows' bin numbers in numpy and emits at most pairs x bins^2 counts once; one small
    shuffle adds them up."""
    cols = cols if cols is not None else numeric_cols(df)
    d = S.nan_to_null(df, cols)
    rng = S.moments(d, cols)
    cols = [c for c in cols if rng[c]["mn"] is not None]
    spark = df.sparkSession
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return spark.createDataFrame([], "a string, b string, bin_a int, bin_b int, count bigint")

    def run(batches):
        import numpy as np
        import pandas as pd
        acc = np.zeros((len(pairs), bins * bins), np.int64)
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            for p, (i, j) in enumerate(pairs):
                both = ~(np.isnan(x[:, i]) | np.isnan(x[:, j]))
                acc[p] += np.bincount((x[both, i] * bins + x[both, j]).astype(np.int64), minlength=bins * bins)
        p, at = np.nonzero(acc)
        yield pd.DataFrame({"p": p.astype(np.int32), "bin_a": (at // bins).astype(np.int32), "bin_b": (at % bins).astype(np.int32), "count": acc[p, at]})

    counted = d.select(*[_bin(c, rng[c], bins).alias(f"c{i}") for i, c in enumerate(cols)]) \
        .mapInPandas(run, "p int, bin_a int, bin_b int, count bigint").groupBy("p", "bin_a", "bin_b").agg(F.sum("count").alias("count"))
    names = spark.createDataFrame([(p, cols[i], cols[j]) for p, (i, j) in enumerate(pairs)], "p int, a string, b string")
    return counted.join(names, "p").select("a", "b", "bin_a", "bin_b", "count")
