"""Automatic table cleaning with a log of every step.

``fit_clean(df)`` makes every data-dependent decision (date columns, dropped columns, fill values,
outlier fences, label codes) from a few small aggregates and returns a ``CleanPlan``;
``plan.apply(df)`` is then one lazy plan: row-wise projections, one de-duplication shuffle,
row-wise projections. The same plan can be applied to new batches (see ``CleanPlan.apply``).

Steps, in order: date detection and parsing, text normalisation, yes/no standardisation, column
pruning, duplicate removal, imputation (median / mode), IQR outlier capping, label encoding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import stats as S
from quarry.functions.text import normalise_text, standardise_values
from quarry.session import stored
from quarry.types import col_of, is_datetime, is_number, is_text

# Fixed values (thresholds and log texts of the cleaning procedure).
DATE_SAMPLE = 10
DATE_SAMPLE_SHARE = 0.7
DATE_PARSE_SHARE = 0.3
DATE_REGEX = r"^\d{4}-\d{1,2}-\d{1,2}$"
DATE_PATTERN = "y-M-d"
MAX_MISSING_SHARE = 0.5
IQR_K = 1.5
MAX_LABELS = 20
UNKNOWN = "unknown"
LOG_INITIAL = "Initial dataset shape: {}"
LOG_DATES = "Parsed date columns: {}"
LOG_STRINGS = "Normalized string columns (excluding dates): {}"
LOG_STANDARD = "Standardized common categorical values (yes/no, nan)"
LOG_DROPPED = "Dropped columns with >50% missing or ≤1 unique value: {}"
LOG_DUPLICATES = "Removed {} duplicate rows"
LOG_MISSING = "Handled {} missing values"
LOG_OUTLIERS = "Capped {} outliers using IQR method"
LOG_ENCODED = "Encoded categorical columns with <20 unique values: {}"
LOG_FINAL = "Final dataset shape: {}"


def parse_date(c: Column) -> Column:
    """Strict ``%Y-%m-%d`` (one-digit month/day accepted, trailing text rejected) -> timestamp."""
    return F.when(c.rlike(DATE_REGEX), F.try_to_timestamp(c, F.lit(DATE_PATTERN))).cast("timestamp_ntz")


def _fields(df: DataFrame):
    return {f.name: f.dataType for f in df.schema.fields}


def _is_complex(t: T.DataType) -> bool:
    return isinstance(t, (T.ArrayType, T.MapType, T.StructType))


def _has_map(t: T.DataType) -> bool:
    return (isinstance(t, T.MapType) or isinstance(t, T.ArrayType) and _has_map(t.elementType)
            or isinstance(t, T.StructType) and any(_has_map(f.dataType) for f in t.fields))


# ---------------------------------------------------------------------------------------------
# Step functions (each returns a small DataFrame of decisions or the transformed frame)

def detect_dates(df: DataFrame, sample_by: list[str] | None = None, sample: int = DATE_SAMPLE) -> DataFrame:
    """Date candidates (CLN-1): text columns of whose non-null values more than 70% parse as dates,
    ``(column, sample_size, sample_parsed, candidate)``. The share is taken over the whole column.
    ``sample_by`` is the parity rule instead: only the first ``sample`` values in that order count
    (one scan for all columns; each task keeps its own first values)."""
    cols = [c for c, t in _fields(df).items() if is_text(t)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, sample_size bigint, sample_parsed bigint, candidate boolean")
    if sample_by:
        keys = [f"o{i}" for i in range(len(sample_by))]
        long = df.select(*[col_of(k).alias(o) for k, o in zip(sample_by, keys)], F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), col_of(c).alias("value")) for c in cols])).alias("x")) \
            .select(*keys, "x.column", "x.value").filter(F.col("value").isNotNull())
        w = Window.partitionBy("column").orderBy(*keys)
        long = long.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= sample)
    else:
        long = S.long_values(df, cols)
    agg = long.groupBy("column").agg(F.count(F.lit(1)).alias("sample_size"),
                                     F.count(parse_date(F.col("value"))).alias("sample_parsed"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    out = names.join(agg, "column", "left").select(
        "column", F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
        F.coalesce("sample_parsed", F.lit(0)).alias("sample_parsed"))
    return out.withColumn("candidate", (F.col("sample_size") > 0) &
                          (F.col("sample_parsed") > F.col("sample_size") * DATE_SAMPLE_SHARE))


def date_parse_counts(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Whole-column parse counts of the candidates (CLN-2): ``(column, parsed, total, converted)``."""
    if not candidates:
        return df.sparkSession.createDataFrame([], "column string, parsed bigint, total bigint, converted boolean")
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(parse_date(col_of(c))).alias(f"c{i}") for i, c in enumerate(candidates)])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("parsed"),
                                                  F.col("__n").alias("total")) for i, c in enumerate(candidates)])).alias("x")) \
        .select("x.*")
    return out.withColumn("converted", (F.col("parsed") > 0) & (F.col("parsed") > F.col("total") * DATE_PARSE_SHARE))


def column_presence(df: DataFrame) -> DataFrame:
    """Null share and whether a column holds at least two distinct values (min < max), from one
    aggregate (no distinct-value shuffle): ``(column, null_share, varied)``."""
    fields = _fields(df)
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[_presence(col_of(c), t).alias(f"c{i}") for i, (c, t) in enumerate(fields.items())])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.try_divide(F.col("__n") - F.col(f"c{i}.nn"), F.col("__n")).alias("null_share"),
                 F.col(f"c{i}.varied").alias("varied")) for i, c in enumerate(fields)])).alias("x")).select("x.*")


def _presence(e: Column, t: T.DataType) -> Column:
    """Non-null count, and whether there are two values at least (complex columns pass through)."""
    return F.struct(F.count(e).alias("nn"), (F.lit(True) if _is_complex(t) else F.coalesce(F.min(e) < F.max(e), F.lit(False))).alias("varied"))


def prune_decisions(df: DataFrame) -> DataFrame:
    """Columns to drop (CLN-5): null share > 0.5 or at most one distinct value."""
    p = column_presence(df)
    return p.withColumn("dropped", (F.coalesce("null_share", F.lit(0.0)) > MAX_MISSING_SHARE) | ~F.col("varied"))


@dataclass
class CleanPlan:
    initial_shape: tuple[int, int] = (0, 0)
    date_cols: list[str] = field(default_factory=list)
    string_cols: list[str] = field(default_factory=list)  # booleans with gaps included: read as text
    drop_cols: list[str] = field(default_factory=list)
    duplicates: int = 0
    missing_before: int = 0
    fills: dict = field(default_factory=dict)
    fences: dict = field(default_factory=dict)
    outliers: int = 0
    labels: dict = field(default_factory=dict)
    final_shape: tuple[int, int] = (0, 0)
    log: list[str] = field(default_factory=list)
    rows: DataFrame | None = None  # the fitted table after the row stage and de-duplication, stored

    # -- row-wise stages -------------------------------------------------------------------
    def rows_stage(self, df: DataFrame) -> DataFrame:
        """Dates, text normalisation, standardisation, column pruning (before de-duplication)."""
        df = S.nan_to_null(df)
        exprs = {c: parse_date(col_of(c)) for c in self.date_cols}
        exprs.update({c: standardise_values(normalise_text(col_of(c).cast("string"))) for c in self.string_cols})
        keep = [c for c in df.columns if c not in self.drop_cols]
        return df.select(*[exprs[c].alias(c) if c in exprs else col_of(c) for c in keep])

    def dedup_stage(self, df: DataFrame) -> DataFrame:
        """Equal rows once. Maps cannot be compared, so their JSON text stands for them."""
        maps = [c for c, t in _fields(df).items() if _has_map(t)]
        if not maps:
            return df.dropDuplicates()
        keyed = df.withColumns({f"__map{i}": F.to_json(F.struct(col_of(c))) for i, c in enumerate(maps)})
        return keyed.dropDuplicates([c for c in keyed.columns if c not in maps]).select(*[col_of(c) for c in df.columns])

    def fill_stage(self, df: DataFrame) -> DataFrame:
        types = _fields(df)
        exprs = {}
        for c, v in self.fills.items():
            if is_number(types[c]):  # a numeric column with gaps is a float column (median fill)
                exprs[c] = F.coalesce(col_of(c).cast("double"), F.lit(float(v)))
            else:
                exprs[c] = F.coalesce(col_of(c), F.lit(v).cast(types[c]))
        return df.withColumns(exprs) if exprs else df

    def clip_stage(self, df: DataFrame) -> DataFrame:
        exprs = {c: F.greatest(F.least(col_of(c).cast("double"), F.lit(hi)), F.lit(lo))
                 for c, (lo, hi) in self.fences.items()}
        return df.withColumns(exprs) if exprs else df

    def encode_stage(self, df: DataFrame) -> DataFrame:
        """Labels to codes; a label that the fit did not see gets the code after the last one."""
        exprs = {}
        for c, labels in self.labels.items():
            m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
            exprs[c] = F.when(col_of(c).isNotNull(), F.coalesce(F.try_element_at(m, col_of(c)), F.lit(len(labels)))).cast("int")
        return df.withColumns(exprs) if exprs else df

    def finish(self, d: DataFrame) -> DataFrame:
        return self.encode_stage(self.clip_stage(self.fill_stage(d)))

    def apply(self, df: DataFrame) -> DataFrame:
        """The plan on a table or a new batch of the same columns (batch only: on a stream the
        de-duplication would keep state for ever). Gaps are filled in columns that had gaps at the
        fit; ``unseen_labels`` counts what the codes do not know."""
        return self.finish(self.dedup_stage(self.rows_stage(df)))

    def unseen_labels(self, df: DataFrame) -> DataFrame:
        """``(column, label, count)`` of labels in ``df`` that the fit did not see."""
        cols = list(self.labels)
        freq = S.value_frequencies(self.fill_stage(self.dedup_stage(self.rows_stage(df))), cols)
        known = [(c, lab) for c in cols for lab in self.labels[c]]
        k = df.sparkSession.createDataFrame(known, "column string, value string")
        return freq.join(F.broadcast(k), ["column", "value"], "left_anti").select("column", F.col("value").alias("label"), F.col("n").alias("count"))

    def log_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, m) for i, m in enumerate(self.log)], "step int, message string")


@dataclass
class CleanResult:
    df: DataFrame
    log: DataFrame
    plan: CleanPlan


def _ranks(gaps: int) -> Callable[[int], set[int]]:
    """The ranks among n values that decide the median, and the quartiles once the gaps are filled."""
    def ranks(n: int) -> set[int]:
        quartiles = S.quantile_ranks(n + gaps, [0.25, 0.75]) if n else set()
        return (S.quantile_ranks(n, [0.5]) if gaps else set()) | {r for q in quartiles for r in (q, q - gaps)}

    return ranks


def _filled_at(r: int, gaps: int, fill, value: Callable[[int], float | None]) -> float:
    """The r-th of a column's values together with ``gaps`` copies of ``fill``, from the values' order."""
    if fill is None or not gaps:
        return value(r)
    below, above = value(r), value(r - gaps)
    if below is not None and below < fill:
        return below
    return above if above is not None and above > fill else fill


def fit_clean(df: DataFrame, date_sample_by: list[str] | None = None) -> CleanPlan:
    """Make every cleaning decision with a handful of small aggregates (B1..B5). The table is read
    for B0-B2 and once more for the de-duplicated copy in the shared folder (``plan.rows``), which
    serves all later passes. ``date_sample_by``: see ``detect_dates``."""
    plan = CleanPlan()
    src = S.nan_to_null(df)
    fields = _fields(src)
    text_all = [c for c, t in fields.items() if is_text(t)]
    bools = [c for c, t in fields.items() if isinstance(t, T.BooleanType)]

    # B0 + B1 + B2 in one pass: row count, whole-column date parse counts, and the pruning
    # statistics (non-null count, at least two values) of every column under both readings of a
    # text column (parsed as dates / normalised text) or of a boolean (as it is / as text)
    parts, names = [F.count(F.lit(1)).alias("__n")], {}

    def want(kind: str, c: str, e: Column) -> None:
        names[kind, c] = f"s{len(names)}"
        parts.append(_presence(e, T.StringType() if kind != "raw" else fields[c]).alias(names[kind, c]))

    for c in src.columns:
        want("raw", c, col_of(c))
        if c in text_all:
            want("date", c, parse_date(col_of(c)))
        if c in text_all + bools:
            want("text", c, standardise_values(normalise_text(col_of(c).cast("string"))))
    row0 = src.agg(*parts).first()
    n0 = row0["__n"]

    def seen(kind: str, c: str):
        return row0[names[kind, c]]

    plan.initial_shape = (n0, len(df.columns))
    plan.log.append(LOG_INITIAL.format(plan.initial_shape))
    if date_sample_by:
        cand = [r["column"] for r in detect_dates(src, date_sample_by).collect() if r["candidate"]] if text_all else []
    else:
        cand = [c for c in text_all if seen("date", c)["nn"] > seen("raw", c)["nn"] * DATE_SAMPLE_SHARE]
    plan.date_cols = [c for c in cand if seen("date", c)["nn"] > 0 and seen("date", c)["nn"] > n0 * DATE_PARSE_SHARE]
    if plan.date_cols:
        plan.log.append(LOG_DATES.format(plan.date_cols))
    gappy = [c for c in bools if seen("raw", c)["nn"] < n0]  # such a column is one of objects, and cleaned as text
    plan.string_cols = [c for c in src.columns if c in text_all + gappy and c not in plan.date_cols]
    plan.log.append(LOG_STRINGS.format(plan.string_cols))
    plan.log.append(LOG_STANDARD)

    def stat(c):
        return seen("date" if c in plan.date_cols else "text" if c in plan.string_cols else "raw", c)

    plan.drop_cols = [c for c in src.columns
                      if (n0 and (n0 - stat(c)["nn"]) / n0 > MAX_MISSING_SHARE) or not stat(c)["varied"]]
    if plan.drop_cols:
        plan.log.append(LOG_DROPPED.format(plan.drop_cols))

    # B3: duplicates, missing values, fill values (on the de-duplicated frame)
    deduped = plan.rows = stored(plan.dedup_stage(plan.rows_stage(src)), "clean")
    types = _fields(deduped)
    row = deduped.agg(F.count(F.lit(1)).alias("__n"),
                      *[F.count_if(col_of(c).isNull()).alias(f"c{i}") for i, c in enumerate(deduped.columns)]).first()
    row = {"__n": row["__n"], **{c: row[f"c{i}"] for i, c in enumerate(deduped.columns)}}
    n1 = row["__n"]
    plan.duplicates = n0 - n1
    if plan.duplicates > 0:
        plan.log.append(LOG_DUPLICATES.format(plan.duplicates))
    gaps = {c: row[c] for c in deduped.columns if row[c] > 0}
    num_cols = [c for c in deduped.columns if is_number(types[c])]
    at, _ = S.order_statistics(deduped, {c: _ranks(row[c]) for c in num_cols})
    plan.missing_before = int(sum(gaps.values()))
    if plan.missing_before > 0:
        for c in (c for c in gaps if is_number(types[c]) and n1 > gaps[c]):
            plan.fills[c] = S.interpolated(n1 - gaps[c], 0.5, lambda r: at[c, r])  # noqa: B023
        txt = [c for c in gaps if is_text(types[c])]
        dts = [c for c in gaps if is_datetime(types[c])]
        modes = {r["column"]: r["mode"] for r in S.modes(deduped, txt + dts).collect()} if txt + dts else {}
        for c in txt:
            plan.fills[c] = modes.get(c, UNKNOWN)
        for c in dts:
            if modes.get(c) is not None:
                plan.fills[c] = modes[c]
        plan.log.append(LOG_MISSING.format(plan.missing_before))

    # B4: outlier fences on the filled numeric columns (a constant column has IQR 0: skipped)
    filled = plan.fill_stage(deduped)
    if num_cols:
        for c in num_cols:
            def value(r: int, c: str = c) -> float:
                """The r-th value once the gaps hold the fill value."""
                return _filled_at(r, row[c], plan.fills.get(c), lambda k: at.get((c, k)))

            q1, q3 = (S.interpolated(n1 if c in plan.fills else n1 - row[c], p, value) for p in (0.25, 0.75))
            if q1 is not None and q3 - q1 > 0:
                iqr = q3 - q1
                plan.fences[c] = (q1 - IQR_K * iqr, q3 + IQR_K * iqr)
        if plan.fences:
            outside = [F.count_if((col_of(c) < lo) | (col_of(c) > hi)) for c, (lo, hi) in plan.fences.items()]
            plan.outliers = int(filled.agg(sum(outside, F.lit(0)).alias("o")).first()["o"])
    if plan.outliers > 0:
        plan.log.append(LOG_OUTLIERS.format(plan.outliers))

    # B5: label codes for text columns with 2..19 distinct values
    clipped = plan.clip_stage(filled)
    txt_cols = [c for c in clipped.columns if is_text(_fields(clipped)[c]) and c not in plan.date_cols]
    if txt_cols:
        # an estimate leaves the columns that can have so few labels; those are counted exactly
        guess = clipped.agg(*[F.approx_count_distinct(col_of(c), 0.05).alias(f"c{i}") for i, c in enumerate(txt_cols)]).first()
        few = [c for i, c in enumerate(txt_cols) if guess[f"c{i}"] < 2 * MAX_LABELS]
        freq = S.value_frequencies(clipped, few)
        counts = {r["column"]: r["k"] for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        enc = [c for c in few if 1 < counts.get(c, 0) < MAX_LABELS]
        if enc:
            vals = freq.filter(F.col("column").isin(enc)).select("column", "value").collect()  # < 20 per column
            for c in enc:
                plan.labels[c] = sorted(r["value"] for r in vals if r["column"] == c)
            plan.log.append(LOG_ENCODED.format(enc))
    plan.final_shape = (n1, len(deduped.columns))
    plan.log.append(LOG_FINAL.format(plan.final_shape))
    return plan


def deep_clean(df: DataFrame, date_sample_by: list[str] | None = None) -> CleanResult:
    """Whole cleaning procedure (CLN-11): decisions, cleaned frame and log."""
    plan = fit_clean(df, date_sample_by)
    return CleanResult(plan.finish(plan.rows), plan.log_frame(df.sparkSession), plan)


def repeated_rows(df: DataFrame) -> int:
    """Rows that repeat an earlier one. Rows are counted by a print of 128 bits, combined on the map side:
    a shuffle of a few numbers a row whatever its width. A second hash tells different rows of one
    print apart; such prints, if there are any, are counted on their whole rows."""
    maps = [c for c, t in _fields(df).items() if _has_map(t)]
    parts = [x for c in df.columns for v in [F.to_json(F.struct(col_of(c))) if c in maps else col_of(c)] for x in (v.isNull(), v)]
    keyed = df.select(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"), F.xxhash64(F.lit(2), *parts).alias("c"),
                      F.struct(*[F.to_json(F.struct(col_of(c))) if c in maps else col_of(c) for c in df.columns]).alias("row"))
    g = keyed.groupBy("a", "b").agg((F.count(F.lit(1)) - 1).alias("k"), (F.min("c") != F.max("c")).alias("mixed"))
    total = g.agg(F.coalesce(F.sum(F.when(~F.col("mixed"), F.col("k"))), F.lit(0)).alias("k"), F.count_if("mixed").alias("mixed")).first()
    if not total["mixed"]:
        return total["k"]
    again = keyed.join(g.where("mixed").select("a", "b"), ["a", "b"], "left_semi").groupBy("row").agg((F.count(F.lit(1)) - 1).alias("k"))
    return total["k"] + again.agg(F.sum("k").alias("k")).first()["k"]


def quality_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns, missing values and duplicate rows before and after cleaning (CLN-12)."""
    def stats(d: DataFrame):
        d = S.nan_to_null(d)
        base = d.agg(F.count(F.lit(1)).alias("rows"), sum((F.count_if(col_of(c).isNull()) for c in d.columns), F.lit(0)).alias("missing")).first()
        return [base["rows"], len(d.columns), int(base["missing"]), repeated_rows(d)]

    b, a = stats(before), stats(after)
    names = ["Rows", "Columns", "Missing Values", "Duplicates"]
    return before.sparkSession.createDataFrame(
        [(i, m, int(x), int(y)) for i, (m, x, y) in enumerate(zip(names, b, a))],
        "position int, metric string, before bigint, after bigint")
