"""Profiling and statistics: metrics, schema profile, missing values, describe, skew/kurtosis,
correlations, distinct counts, value frequencies, reports and fallback insights.

All per-column work is one aggregate or one long-format shuffle; results are small DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import stats as S
from quarry.functions.running import running_sum
from quarry.types import col_of, numeric_cols, simple_cols, text_cols, type_class

# Answer clean-up texts and the fallback insight labels.
QUOTA_MESSAGE = ("<span style='color:red;'><b>⚠️ Gemini API quota exceeded.</b><br>"
                 "You have reached your usage limit for the Gemini API.<br>"
                 "Please check your <a href='https://ai.google.dev/gemini-api/docs/rate-limits' "
                 "target='_blank'>quota and billing details</a>.<br>"
                 "Wait a minute and try again, or upgrade your plan if needed.</span>")
ERROR_PREFIX = "Error generating insights: "
WELL_STRUCTURED = "well-structured"
MODERATELY_CLEAN = "moderately clean"


def table_metrics(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and text column counts (PRF-1)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(numeric_cols(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_cols(df))).cast("bigint").alias("text_columns"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, non_null, nulls)`` from one aggregate pass."""
    cols = cols if cols is not None else df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(col_of(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    stacked = row.select("__n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("non_null")) for i, c in enumerate(cols)])).alias("s"))
    return stacked.select("s.column", "s.non_null", (F.col("__n") - F.col("s.non_null")).alias("nulls"))


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, non-null and null counts (PRF-2)."""
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), type_class(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "position int, column string, data_type string, type_class string")
    return types.join(F.broadcast(null_counts(df)), "column")


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, only columns with gaps, most first (PRF-3, VIZ-9)."""
    return null_counts(df).filter(F.col("nulls") > 0).select("column", F.col("nulls").alias("missing")) \
        .orderBy(F.col("missing").desc(), F.col("column"))


def missing_total(df: DataFrame) -> Column:
    """Total missing cells (an aggregate expression)."""
    return sum((F.count_if(col_of(c).isNull()) for c in df.columns), F.lit(0)).cast("bigint")


DESCRIBE_SCHEMA = ("column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
                   "q75 double, max double")


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles (exact, linear) and max per numeric column (PRF-4);
    unrounded; a table without number columns gives an empty frame. One moments aggregate and the
    quantile passes; the result has one row per column."""
    cols = cols if cols is not None else numeric_cols(df)
    d = S.nan_to_null(df, cols)
    m, q = S.moments(d, cols), S.quantile_map(d, cols, [0.25, 0.5, 0.75])
    return df.sparkSession.createDataFrame(
        [(c, m[c]["n"], m[c]["mean"], m[c]["std"], m[c]["mn"], q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], m[c]["mx"])
         for c in cols], DESCRIBE_SCHEMA)


def skew_kurtosis(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per numeric column (PRF-5, PRF-6); empty without
    number columns."""
    cols = cols if cols is not None else numeric_cols(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, skew double, kurtosis double")
    d = S.nan_to_null(df, cols)
    parts = []
    for c in cols:
        x = col_of(c).cast("double")
        n = F.count(x).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"),
                              S.sample_skew(x, n, F.min(x), F.max(x)).alias("skew"),
                              S.sample_kurtosis(x, n, F.min(x), F.max(x)).alias("kurtosis")))
    return d.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(a, b, r)``: all ordered pairs, pairwise complete rows, null
    for a constant column (PRF-7, VIZ-2). Two passes of plain sums (``corr_pairs``), mirrored."""
    cols = cols if cols is not None else numeric_cols(df)
    r = S.corr_pairs(S.nan_to_null(df, cols), cols)
    data = [(a, b, r[(a, b)] if (a, b) in r else r[(b, a)]) for a in cols for b in cols]
    return df.sparkSession.createDataFrame(data, "a string, b string, r double")


def nunique(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Distinct non-null values per column (PRF-8)."""
    cols = cols if cols is not None else simple_cols(df)
    return S.distinct_counts(S.nan_to_null(df, cols), cols)


def value_counts(df: DataFrame, cols: list[str] | None = None, top: int | None = None) -> DataFrame:
    """``(column, value, count)``: frequencies of every value (PRF-9); with ``top`` only the ``top``
    most frequent, and their ``rank`` (count desc, then value asc)."""
    cols = cols if cols is not None else text_cols(df)
    freq = S.value_frequencies(df, cols)
    if top is None:
        return freq.select("column", "value", F.col("n").alias("count"))
    return S.top_values(freq, top) \
        .select("column", "value", F.col("n").alias("count"), F.col("rank").cast("int").alias("rank"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per Spark type (PRF-10)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "data_type string, columns bigint")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (PRF-15), from one aggregate over the grouped rows."""
    g = df.groupBy(*[col_of(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__k"))
    return g.agg(F.coalesce(F.sum(F.col("__k") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def stats_report_numeric(df: DataFrame) -> DataFrame:
    """Numeric part of the statistics report: describe + skew + kurtosis (PRF-11)."""
    return describe(df).join(skew_kurtosis(df), "column")


def stats_report_text(df: DataFrame, top: int = 5) -> DataFrame:
    """Text part of the report: distinct count and top values per text column (PRF-11)."""
    cols = text_cols(df)
    freq = S.value_frequencies(df, cols)
    nun = freq.groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    return S.top_values(freq, top).join(nun, "column") \
        .select("column", "nunique", F.col("rank").cast("int").alias("rank"), "value", F.col("n").alias("count"))


def statistical_analysis(df: DataFrame, top: int = 5) -> DataFrame:
    """The whole statistics report in one frame (PRF-11), ``(section, column, item, number, text)``:
    ``numeric`` (describe, skew, kurtosis), ``correlation`` (item: the other column) and ``text``
    (distinct count and the ``top`` values). Sections without columns are absent."""
    num = stats_report_numeric(df)
    items = [c for c in num.columns if c != "column"]
    numeric = num.select(F.lit("numeric").alias("section"), "column", F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("number")) for c in items])).alias("x")) \
        .select("section", "column", "x.item", "x.number", F.lit(None).cast("string").alias("text"))
    corr = corr_matrix(df).select(F.lit("correlation").alias("section"), F.col("a").alias("column"), F.col("b").alias("item"),
                                  F.col("r").alias("number"), F.lit(None).cast("string").alias("text"))
    text = stats_report_text(df, top)
    top_rows = text.select(F.lit("text").alias("section"), "column", F.concat(F.lit("top "), "rank").alias("item"),
                           F.col("count").cast("double").alias("number"), F.col("value").alias("text"))
    distinct = text.select(F.lit("text").alias("section"), "column", F.lit("nunique").alias("item"),
                           F.col("nunique").cast("double").alias("number"), F.lit(None).cast("string").alias("text")).distinct()
    return numeric.unionByName(corr).unionByName(top_rows).unionByName(distinct)


SUMMARY_ROWS = 5  # fixed value: first rows shown in the summary


def dataset_summary(df: DataFrame, log: DataFrame | None = None, order_by: list[str] | None = None) -> DataFrame:
    """What the insight prompt is made from (PRF-12), ``(section, name, value)``: shape, column types,
    missing values, statistics, frequencies of text columns, the first rows (as JSON, in ``order_by``
    order) and the cleaning log."""
    def part(section: str, d: DataFrame, name: Column, value: Column) -> DataFrame:
        return d.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    num = describe(df)
    stats = num.select("column", F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v"))
                                                     for c in num.columns if c != "column"])).alias("x"))
    types = schema_profile(df)
    rows = preview(df, SUMMARY_ROWS, order_by)
    out = part("shape", table_metrics(df), F.lit("shape"), F.concat_ws(" x ", "rows", "columns"))
    for p in (part("types", types, F.col("column"), F.col("data_type")),
              part("missing", null_counts(df), F.col("column"), F.col("nulls")),
              part("statistics", stats, F.concat_ws(".", "column", "x.k"), F.col("x.v")),
              part("values", value_counts(df), F.concat_ws("=", "column", "value"), F.col("count")),
              part("rows", rows, F.lit("row"), F.to_json(F.struct(*[col_of(c) for c in rows.columns])))):
        out = out.unionByName(p)
    return out if log is None else out.unionByName(part("log", log, F.col("step"), F.col("message")))


# Fixed value: what the insight prompt asks for.
INSIGHT_REQUEST = """Analyze this dataset and provide deep, actionable insights. Do not use markdown or asterisks. Format your response in clear sections with numbered or bulleted lists. Include:
1. Key findings and patterns
2. Data quality assessment
3. Potential business or research insights
4. Recommendations for further analysis
5. Notable correlations or trends
6. Statistical anomalies or outliers
7. Any detected data issues or suggestions
8. If possible, suggest predictive features or targets"""
# Titles of the summary's parts, in their order.
SUMMARY_TITLES = {"shape": "Shape", "types": "Data types", "missing": "Missing values", "statistics": "Numeric summary",
                  "values": "Categorical summary", "log": "Cleaning Operations Performed", "rows": "Sample data"}


def insight_prompt(df: DataFrame, log: DataFrame | None = None, order_by: list[str] | None = None) -> DataFrame:
    """The model's prompt about a table (PRF-12): ``(position, line)``. The request, then the parts of
    ``dataset_summary`` under their titles, a line for each row: statistics and frequencies by name, log
    steps and sample rows in their order. Lines, since the frequencies have no bound; joined by newlines
    they are the prompt."""
    titles = list(SUMMARY_TITLES)
    summary = dataset_summary(df, log, order_by)
    part = F.array_position(F.array(*map(F.lit, titles)), F.col("section")).cast("int")
    shown = F.when(F.col("section") == "shape", F.replace("value", F.lit(" x "), F.lit(", "))) \
        .when(F.col("section").isin("log", "rows"), F.col("value")).otherwise(F.concat_ws(": ", "name", F.coalesce("value", F.lit("null"))))
    lines = summary.select(part.alias("part"), F.lit(1).alias("kind"),
                           F.when(F.col("section") == "log", F.lpad("name", 9, "0")).otherwise(F.col("name")).alias("name"), shown.alias("line"))
    present = [t for t in titles if t != "log" or log is not None]
    heads = [(0, 0, "", x) for x in [*INSIGHT_REQUEST.split("\n"), "Dataset Overview:"]] + [(titles.index(t) + 1, 0, "", f"- {SUMMARY_TITLES[t]}:") for t in present]
    fixed = df.sparkSession.createDataFrame([(p, k, f"{i:09d}", x) for i, (p, k, _, x) in enumerate(heads)], lines.schema)
    numbered = running_sum(fixed.unionByName(lines).withColumn("prompt", F.lit(0)), "prompt", ["part", "kind", "name", "line"], F.lit(1), "position")
    return numbered.select("position", "line")


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows (5..50 in the app) in a stated order (PRF-14)."""
    n = max(1, int(n))
    return (df.orderBy(*[col_of(c) for c in order_by]) if order_by else df).limit(n)


def basic_insights(after: DataFrame, rows_before: int, log_steps: int) -> DataFrame:
    """Deterministic fallback insights (PRF-13): records, features, column kinds, rows removed,
    issues addressed (log length), and a quality label. ``rows_before`` comes from the clean log."""
    a = after.agg(F.count(F.lit(1)).alias("records"), missing_total(after).alias("missing"))
    return a.select(
        "records", F.lit(len(after.columns)).cast("bigint").alias("features"),
        F.lit(len(numeric_cols(after))).cast("bigint").alias("numeric_columns"),
        F.lit(len(text_cols(after))).cast("bigint").alias("text_columns"),
        (F.lit(rows_before).cast("bigint") - F.col("records")).alias("rows_removed"),
        F.lit(log_steps).cast("bigint").alias("issues_addressed"),
        F.when(F.col("missing") == 0, WELL_STRUCTURED).otherwise(MODERATELY_CLEAN).alias("quality"))


def clean_answers(answer: Column, error: Column) -> Column:
    """Model answer as shown (PRF-16): asterisks removed; a quota error gets the fixed notice,
    other errors a prefixed message; newlines become ``<br>``."""
    err = F.when(F.lower(error).contains("quota") | error.contains("429"), F.lit(QUOTA_MESSAGE)) \
        .otherwise(F.concat(F.lit(ERROR_PREFIX), error))
    text = F.when(error.isNotNull(), err).otherwise(F.replace(answer, F.lit("*"), F.lit("")))
    return F.replace(text, F.lit("\n"), F.lit("<br>"))
