"""Table cleaning, profiling, statistics and chart-data queries.

Cleaning runs on the dirty ``orders`` / ``part`` fixtures; profiling and charts on ``lineitem``
(plus ``part`` / ``customer`` for text charts). Every double in an output is cut to
seven significant digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import stats as S
from quarry.operators import charts as V
from quarry.operators import clean as C
from quarry.operators import profile as P
from quarry.plans.fixtures import (DIRTY_ORDERS, DIRTY_PARTS, dirty_orders, dirty_parts, sql_clean_text,
                                   sql_normalise, sql_parse_date)
from quarry.plans.registry import Tables, query

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_TEXT = ["l_returnflag", "l_linestatus"]


def sig_doubles(df: DataFrame) -> DataFrame:
    """Doubles to seven significant digits (operators do not round; sums are merged in task order).
    The factor moves exact ties, which the two engines would round apart, off the tie."""
    def cut(x):
        return F.when(x.isNotNull(), F.format_string("%.6e", x * 1.000000000001 + 0.0)).cast("double")

    return df.select(*[cut(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def _li_long(cols, alias="value"):
    """DuckDB: lineitem numeric columns unpivoted to ("column", value DOUBLE)."""
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"""(UNPIVOT (SELECT {sel} FROM lineitem) ON {", ".join(cols)} INTO NAME "column" VALUE {alias})"""


def _spark_type_sql(expr: str) -> str:
    """DuckDB type name of an expression, spelled the Spark way."""
    return (f"CASE typeof({expr}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
            f"WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({expr})) END")


# ------------------------------------------------------------------------------------------
# Cleaning steps

ORDERS_TEXT = ["o_orderstatus", "order_day", "sparse_flag", "constant_col", "o_orderpriority"]
# Stage after dates / text / standardisation / pruning (the decisions are checked by the
# detect_dates, date_parse_share and prune_columns keys).
STAGED = f"""staged AS (SELECT o_orderkey, o_custkey, {sql_clean_text('o_orderstatus')} AS o_orderstatus,
  price_gaps, price_outliers, {sql_parse_date('order_day')} AS order_day,
  {sql_clean_text('o_orderpriority')} AS o_orderpriority FROM dirty),
dedup AS (SELECT DISTINCT * FROM staged),
fills AS (SELECT quantile_cont(price_gaps, 0.5) AS med,
  (SELECT order_day FROM dedup WHERE order_day IS NOT NULL GROUP BY order_day ORDER BY count(*) DESC, order_day LIMIT 1) AS day_mode
  FROM dedup),
filled AS (SELECT o_orderkey, o_custkey, o_orderstatus, coalesce(price_gaps, med) AS price_gaps, price_outliers,
  coalesce(order_day, day_mode) AS order_day, o_orderpriority FROM dedup, fills),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"
                        for c in ("o_orderkey", "o_custkey", "price_gaps", "price_outliers"))} FROM filled),
fences AS (SELECT {", ".join(f"{c}_q1 - 1.5 * ({c}_q3 - {c}_q1) AS {c}_lo, {c}_q3 + 1.5 * ({c}_q3 - {c}_q1) AS {c}_hi"
                             for c in ("o_orderkey", "o_custkey", "price_gaps", "price_outliers"))} FROM q)"""


@query("detect_dates", f"""WITH {DIRTY_ORDERS},
long AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey) AS rn
  FROM (UNPIVOT (SELECT o_orderkey, {", ".join(ORDERS_TEXT)} FROM dirty) ON {", ".join(ORDERS_TEXT)}
        INTO NAME "column" VALUE value))
SELECT "column", count(*) AS sample_size, count({sql_parse_date('value')}) AS sample_parsed,
  count({sql_parse_date('value')}) > 0.7 * count(*) AS candidate
FROM long WHERE rn <= 10 GROUP BY "column" """)
def q_detect_dates(spark, sf_dir):
    return C.detect_dates(dirty_orders(Tables(spark, sf_dir)), sample_by=["o_orderkey"])


@query("date_parse_share", f"""WITH {DIRTY_ORDERS}
SELECT 'order_day' AS "column", count({sql_parse_date('order_day')}) AS parsed, count(*) AS total,
  count({sql_parse_date('order_day')}) > 0 AND count({sql_parse_date('order_day')}) > 0.3 * count(*) AS converted
FROM dirty""")
def q_date_parse_share(spark, sf_dir):
    d = dirty_orders(Tables(spark, sf_dir))
    cand = [r["column"] for r in C.detect_dates(d, ["o_orderkey"]).collect() if r["candidate"]]
    return C.date_parse_counts(d, cand)


@query("parse_dates", f"""WITH {DIRTY_ORDERS}
SELECT o_orderkey, {sql_parse_date('order_day')} AS order_day FROM dirty""")
def q_parse_dates(spark, sf_dir):
    d = dirty_orders(Tables(spark, sf_dir))
    return d.select("o_orderkey", C.parse_date(F.col("order_day")).alias("order_day"))


@query("normalise_text", f"""WITH {DIRTY_PARTS}
SELECT p_partkey, {sql_normalise('p_name')} AS p_name, {sql_normalise('p_brand')} AS p_brand,
  {sql_normalise('p_type')} AS p_type, {sql_normalise('in_stock')} AS in_stock FROM dparts""")
def q_normalise_text(spark, sf_dir):
    from quarry.functions.text import normalise_text
    d = dirty_parts(Tables(spark, sf_dir))
    return d.select("p_partkey", *[normalise_text(F.col(c)).alias(c) for c in ("p_name", "p_brand", "p_type", "in_stock")])


@query("standardise_values", f"""WITH {DIRTY_PARTS}
SELECT p_partkey, {sql_clean_text('p_name')} AS p_name, {sql_clean_text('in_stock')} AS in_stock FROM dparts""")
def q_standardise_values(spark, sf_dir):
    from quarry.functions.text import normalise_text, standardise_values
    d = dirty_parts(Tables(spark, sf_dir))
    return d.select("p_partkey", *[standardise_values(normalise_text(F.col(c))).alias(c) for c in ("p_name", "in_stock")])


@query("prune_columns", f"""WITH {DIRTY_ORDERS},
s AS (SELECT o_orderkey, o_custkey, {sql_clean_text('o_orderstatus')} AS o_orderstatus, price_gaps, price_outliers,
  {sql_parse_date('order_day')} AS order_day, {sql_clean_text('sparse_flag')} AS sparse_flag,
  {sql_clean_text('constant_col')} AS constant_col, {sql_clean_text('o_orderpriority')} AS o_orderpriority FROM dirty),
p AS (SELECT * FROM (VALUES
  {", ".join(f"('{c}', (SELECT CAST(printf('%.6e', CAST(1 - count({c}) / count(*) AS DOUBLE) * 1.000000000001) AS DOUBLE) FROM s), (SELECT count(DISTINCT {c}) FROM s))"
             for c in ("o_orderkey", "o_custkey", "o_orderstatus", "price_gaps", "price_outliers", "order_day",
                       "sparse_flag", "constant_col", "o_orderpriority"))}) t("column", null_share, nd))
SELECT "column", null_share, nd > 1 AS varied, null_share > 0.5 OR nd <= 1 AS dropped FROM p""")
def q_prune_columns(spark, sf_dir):
    d = dirty_orders(Tables(spark, sf_dir))
    plan = C.CleanPlan(date_cols=["order_day"],
                       string_cols=["o_orderstatus", "sparse_flag", "constant_col", "o_orderpriority"])
    return sig_doubles(C.prune_decisions(plan.rows_stage(d)))


@query("drop_duplicate_rows", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT (SELECT count(*) FROM staged) AS rows_before, (SELECT count(*) FROM dedup) AS rows_after,
  (SELECT count(*) FROM staged) - (SELECT count(*) FROM dedup) AS removed""")
def q_drop_duplicate_rows(spark, sf_dir):
    plan = C.fit_clean(dirty_orders(Tables(spark, sf_dir)), ["o_orderkey"])
    n0 = plan.initial_shape[0]
    return spark.createDataFrame([(n0, n0 - plan.duplicates, plan.duplicates)],
                                 "rows_before bigint, rows_after bigint, removed bigint")


def _orders_plan(spark, sf_dir):
    return C.fit_clean(dirty_orders(Tables(spark, sf_dir)), ["o_orderkey"])


@query("impute_median", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT 'price_gaps' AS "column", CAST(printf('%.6e', CAST(med AS DOUBLE) * 1.000000000001) AS DOUBLE) AS fill FROM fills""")
def q_impute_median(spark, sf_dir):
    plan = _orders_plan(spark, sf_dir)
    num = [(c, float(v)) for c, v in plan.fills.items() if isinstance(v, (int, float))]
    return sig_doubles(spark.createDataFrame(num, "column string, fill double"))


@query("impute_date_mode", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT 'order_day' AS "column", day_mode AS fill FROM fills""")
def q_impute_date_mode(spark, sf_dir):
    plan = _orders_plan(spark, sf_dir)
    d = spark.createDataFrame([(c, str(plan.fills[c])) for c in plan.date_cols if c in plan.fills],
                              "column string, fill string")
    return d.select("column", F.col("fill").cast("timestamp_ntz").alias("fill"))


@query("impute_mode", f"""WITH {DIRTY_PARTS},
s AS (SELECT {sql_clean_text('in_stock')} AS in_stock FROM dparts)
SELECT 'in_stock' AS "column", (SELECT in_stock FROM s WHERE in_stock IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, in_stock LIMIT 1) AS fill""")
def q_impute_mode(spark, sf_dir):
    plan = C.fit_clean(dirty_parts(Tables(spark, sf_dir)), ["p_partkey"])
    return spark.createDataFrame([(c, v) for c, v in plan.fills.items() if isinstance(v, str)],
                                 "column string, fill string")


@query("outlier_fences", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT * FROM (VALUES {", ".join(
    f"('{c}', (SELECT CAST(printf('%.6e', CAST({c}_lo AS DOUBLE) * 1.000000000001) AS DOUBLE) FROM fences), (SELECT CAST(printf('%.6e', CAST({c}_hi AS DOUBLE) * 1.000000000001) AS DOUBLE) FROM fences), "
    f"(SELECT count(*) FROM filled, fences WHERE {c} < {c}_lo OR {c} > {c}_hi))"
    for c in ("o_orderkey", "o_custkey", "price_gaps", "price_outliers"))}) t("column", lower_fence, upper_fence, outliers)""")
def q_outlier_fences(spark, sf_dir):
    t = Tables(spark, sf_dir)
    plan = _orders_plan(spark, sf_dir)
    d = plan.fill_stage(plan.rows)  # the frame the fit read
    rows = [F.struct(F.lit(c).alias("column"), F.lit(lo).alias("lower_fence"), F.lit(hi).alias("upper_fence"),
                     F.count_if((F.col(c) < lo) | (F.col(c) > hi)).cast("bigint").alias("outliers"))
            for c, (lo, hi) in plan.fences.items()]
    return sig_doubles(d.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*"))


@query("outlier_counts", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT * FROM (VALUES {", ".join(
    f"('{c}', (SELECT count(*) FROM filled, fences WHERE {c} < {c}_lo OR {c} > {c}_hi))"
    for c in ("o_orderkey", "o_custkey", "price_gaps", "price_outliers"))}) t("column", outliers)""")
def q_outlier_counts(spark, sf_dir):
    """Values strictly outside the IQR fences per numeric column (the capped-outlier count)."""
    return q_outlier_fences(spark, sf_dir).select("column", "outliers")


CLEANED_ORDERS = f"""cleaned AS (SELECT
  CAST(printf('%.6e', CAST(greatest(least(CAST(o_orderkey AS DOUBLE), o_orderkey_hi), o_orderkey_lo) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS o_orderkey,
  CAST(printf('%.6e', CAST(greatest(least(CAST(o_custkey AS DOUBLE), o_custkey_hi), o_custkey_lo) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS o_custkey,
  CAST((SELECT count(DISTINCT x.o_orderstatus) FROM filled x WHERE x.o_orderstatus < f.o_orderstatus) AS INTEGER) AS o_orderstatus,
  CAST(printf('%.6e', CAST(greatest(least(price_gaps, price_gaps_hi), price_gaps_lo) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS price_gaps,
  CAST(printf('%.6e', CAST(greatest(least(price_outliers, price_outliers_hi), price_outliers_lo) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS price_outliers,
  order_day,
  CAST((SELECT count(DISTINCT x.o_orderpriority) FROM filled x WHERE x.o_orderpriority < f.o_orderpriority) AS INTEGER) AS o_orderpriority
FROM filled f, fences)"""


@query("cap_outliers", f"""WITH {DIRTY_ORDERS}, {STAGED}, {CLEANED_ORDERS}
SELECT o_orderkey, price_gaps, price_outliers FROM cleaned""")
def q_cap_outliers(spark, sf_dir):
    plan = _orders_plan(spark, sf_dir)
    d = plan.clip_stage(plan.fill_stage(plan.rows))
    return sig_doubles(d.select("o_orderkey", "price_gaps", "price_outliers"))


@query("deep_clean", f"""WITH {DIRTY_ORDERS}, {STAGED}, {CLEANED_ORDERS}
SELECT * FROM cleaned""")
def q_deep_clean(spark, sf_dir):
    res = C.deep_clean(dirty_orders(Tables(spark, sf_dir)), date_sample_by=["o_orderkey"])
    return sig_doubles(res.df)


@query("label_encode", f"""WITH {DIRTY_PARTS},
s AS (SELECT {sql_clean_text('p_type')} AS p_type, {sql_clean_text('in_stock')} AS in_stock FROM dparts),
m AS (SELECT in_stock AS fill FROM s WHERE in_stock IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, in_stock LIMIT 1),
lab AS (SELECT 'p_type' AS "column", p_type AS label FROM s
        UNION SELECT 'in_stock', coalesce(in_stock, (SELECT fill FROM m)) FROM s)
SELECT "column", label, CAST(row_number() OVER (PARTITION BY "column" ORDER BY label) - 1 AS INTEGER) AS code
FROM lab""")
def q_label_encode(spark, sf_dir):
    plan = C.fit_clean(dirty_parts(Tables(spark, sf_dir)), ["p_partkey"])
    return spark.createDataFrame([(c, lab, i) for c, labs in plan.labels.items() for i, lab in enumerate(labs)],
                                 "column string, label string, code int")


@query("deep_clean_parts", f"""WITH {DIRTY_PARTS},
s AS (SELECT p_partkey, {sql_clean_text('p_name')} AS p_name, {sql_clean_text('p_brand')} AS p_brand,
  {sql_clean_text('p_type')} AS p_type, p_size, p_retailprice, {sql_clean_text('in_stock')} AS in_stock FROM dparts),
f AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, coalesce(in_stock,
  (SELECT in_stock FROM s WHERE in_stock IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, in_stock LIMIT 1)) AS in_stock FROM s),
q AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3"
                        for c in ("p_partkey", "p_size", "p_retailprice"))} FROM f)
SELECT {", ".join(f"CAST(printf('%.6e', CAST(greatest(least(CAST({c} AS DOUBLE), {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)), {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS {c}"
                  for c in ("p_partkey", "p_size", "p_retailprice"))},
  p_name, p_brand,
  CAST((SELECT count(DISTINCT x.p_type) FROM f x WHERE x.p_type < f.p_type) AS INTEGER) AS p_type,
  CAST((SELECT count(DISTINCT x.in_stock) FROM f x WHERE x.in_stock < f.in_stock) AS INTEGER) AS in_stock
FROM f, q""")
def q_deep_clean_parts(spark, sf_dir):
    res = C.deep_clean(dirty_parts(Tables(spark, sf_dir)), date_sample_by=["p_partkey"])
    return sig_doubles(res.df)


@query("clean_log", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT * FROM (VALUES
 (1, 'Initial dataset shape: (' || (SELECT count(*) FROM dirty) || ', 9)'),
 (2, 'Parsed date columns: [''order_day'']'),
 (3, 'Normalized string columns (excluding dates): [''o_orderstatus'', ''sparse_flag'', ''constant_col'', ''o_orderpriority'']'),
 (4, 'Standardized common categorical values (yes/no, nan)'),
 (5, 'Dropped columns with >50% missing or ≤1 unique value: [''sparse_flag'', ''constant_col'']'),
 (6, 'Removed ' || ((SELECT count(*) FROM staged) - (SELECT count(*) FROM dedup)) || ' duplicate rows'),
 (7, 'Handled ' || (SELECT count(*) FILTER (WHERE price_gaps IS NULL) + count(*) FILTER (WHERE order_day IS NULL) FROM dedup) || ' missing values'),
 (8, 'Capped ' || (SELECT {' + '.join(f'count(*) FILTER (WHERE {c} < {c}_lo OR {c} > {c}_hi)' for c in ('o_orderkey', 'o_custkey', 'price_gaps', 'price_outliers'))} FROM filled, fences) || ' outliers using IQR method'),
 (9, 'Encoded categorical columns with <20 unique values: [''o_orderstatus'', ''o_orderpriority'']'),
 (10, 'Final dataset shape: (' || (SELECT count(*) FROM dedup) || ', 7)')) t(step, message)""")
def q_clean_log(spark, sf_dir):
    return _orders_plan(spark, sf_dir).log_frame(spark)


@query("quality_comparison", f"""WITH {DIRTY_ORDERS}, {STAGED}, {CLEANED_ORDERS}
SELECT * FROM (VALUES
 (0, 'Rows', (SELECT count(*) FROM dirty), (SELECT count(*) FROM cleaned)),
 (1, 'Columns', 9, 7),
 (2, 'Missing Values', (SELECT count(*) FILTER (WHERE price_gaps IS NULL) + count(*) FILTER (WHERE sparse_flag IS NULL) FROM dirty), 0),
 (3, 'Duplicates', (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)),
    (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned))))
 t(position, metric, before, after)""")
def q_quality_comparison(spark, sf_dir):
    d = dirty_orders(Tables(spark, sf_dir))
    res = C.deep_clean(d, ["o_orderkey"])
    return C.quality_comparison(d, res.df)


@query("basic_insights", f"""WITH {DIRTY_ORDERS}, {STAGED}, {CLEANED_ORDERS}
SELECT count(*) AS records, CAST(7 AS BIGINT) AS features, CAST(6 AS BIGINT) AS numeric_columns,
  CAST(0 AS BIGINT) AS text_columns, (SELECT count(*) FROM dirty) - count(*) AS rows_removed,
  CAST(10 AS BIGINT) AS issues_addressed,
  'well-structured' AS quality FROM cleaned""")
def q_basic_insights(spark, sf_dir):
    d = dirty_orders(Tables(spark, sf_dir))
    res = C.deep_clean(d, ["o_orderkey"])
    return P.basic_insights(res.df, res.plan.initial_shape[0], len(res.plan.log))


# ------------------------------------------------------------------------------------------
# Profiling

@query("table_metrics", """SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns, CAST(8 AS BIGINT) AS numeric_columns,
  CAST(2 AS BIGINT) AS text_columns FROM lineitem""")
def q_table_metrics(spark, sf_dir):
    return P.table_metrics(Tables(spark, sf_dir).lineitem)


@query("schema_profile", f"""WITH {DIRTY_ORDERS}
SELECT * FROM (VALUES {", ".join(
    f"({i}, '{c}', (SELECT {_spark_type_sql(c)} FROM dirty LIMIT 1), "
    f"CASE WHEN '{c}' IN ('o_orderstatus','order_day','sparse_flag','constant_col','o_orderpriority') THEN 'text' ELSE 'number' END, "
    f"(SELECT count({c}) FROM dirty), (SELECT count(*) - count({c}) FROM dirty))"
    for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "price_gaps", "price_outliers", "order_day",
                           "sparse_flag", "constant_col", "o_orderpriority"]))}) t(position, "column", data_type, type_class, non_null, nulls)""")
def q_schema_profile(spark, sf_dir):
    return P.schema_profile(dirty_orders(Tables(spark, sf_dir)))


@query("missing_counts", f"""WITH {DIRTY_ORDERS}
SELECT * FROM (SELECT 'price_gaps' AS "column", count(*) - count(price_gaps) AS missing FROM dirty
  UNION ALL SELECT 'sparse_flag', count(*) - count(sparse_flag) FROM dirty) WHERE missing > 0""")
def q_missing_counts(spark, sf_dir):
    return P.missing_counts(dirty_orders(Tables(spark, sf_dir)))


@query("describe", f"""SELECT "column", count(value) AS count, CAST(printf('%.6e', CAST(avg(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS mean,
  CAST(printf('%.6e', CAST(stddev_samp(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS std, CAST(printf('%.6e', CAST(min(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS min, CAST(printf('%.6e', CAST(quantile_cont(value, 0.25) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q25,
  CAST(printf('%.6e', CAST(quantile_cont(value, 0.5) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q50, CAST(printf('%.6e', CAST(quantile_cont(value, 0.75) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q75, CAST(printf('%.6e', CAST(max(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS max
FROM {_li_long(LI_NUM)} GROUP BY "column" """)
def q_describe(spark, sf_dir):
    return sig_doubles(P.describe(Tables(spark, sf_dir).lineitem))


@query("skew_kurtosis", f"""SELECT "column", CAST(printf('%.6e', CAST(skewness(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS skew, CAST(printf('%.6e', CAST(kurtosis(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS kurtosis
FROM {_li_long(LI_NUM)} GROUP BY "column" """)
def q_skew_kurtosis(spark, sf_dir):
    return sig_doubles(P.skew_kurtosis(Tables(spark, sf_dir).lineitem))


@query("corr_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CAST(printf('%.6e', CAST(corr({a}, {b}) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS r FROM lineitem" for a in LI_NUM for b in LI_NUM) + ")")
def q_corr_matrix(spark, sf_dir):
    return sig_doubles(P.corr_matrix(Tables(spark, sf_dir).lineitem))


@query("corr_constant", f"""WITH {DIRTY_ORDERS}
SELECT * FROM (VALUES
 ('price_gaps', 'price_gaps', (SELECT CAST(printf('%.6e', CAST(corr(price_gaps, price_gaps) AS DOUBLE) * 1.000000000001) AS DOUBLE) FROM dirty)),
 ('price_gaps', 'price_outliers', (SELECT CAST(printf('%.6e', CAST(corr(price_gaps, price_outliers) AS DOUBLE) * 1.000000000001) AS DOUBLE) FROM dirty)),
 ('price_outliers', 'price_gaps', (SELECT CAST(printf('%.6e', CAST(corr(price_gaps, price_outliers) AS DOUBLE) * 1.000000000001) AS DOUBLE) FROM dirty)),
 ('price_outliers', 'price_outliers', (SELECT CAST(printf('%.6e', CAST(corr(price_outliers, price_outliers) AS DOUBLE) * 1.000000000001) AS DOUBLE) FROM dirty)),
 ('price_gaps', 'flat', NULL), ('flat', 'price_gaps', NULL), ('price_outliers', 'flat', NULL),
 ('flat', 'price_outliers', NULL), ('flat', 'flat', NULL)) t(a, b, r)""")
def q_corr_constant(spark, sf_dir):
    """Pairwise-complete correlations with gaps and a constant column (null, never an error)."""
    d = dirty_orders(Tables(spark, sf_dir)).withColumn("flat", F.lit(1.0))
    return sig_doubles(P.corr_matrix(d, ["price_gaps", "price_outliers", "flat"]))


LI_ALL = LI_NUM + LI_TEXT + ["l_shipdate"]


@query("nunique", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', (SELECT count(DISTINCT {c}) FROM lineitem))" for c in LI_ALL) + ') t("column", nunique)')
def q_nunique(spark, sf_dir):
    return P.nunique(Tables(spark, sf_dir).lineitem)


@query("value_counts", """SELECT "column", value, count(*) AS count
FROM (UNPIVOT (SELECT l_returnflag, l_linestatus FROM lineitem) ON l_returnflag, l_linestatus
      INTO NAME "column" VALUE value) GROUP BY "column", value""")
def q_value_counts(spark, sf_dir):
    return P.value_counts(Tables(spark, sf_dir).lineitem)


PART_TEXT = ["p_name", "p_brand", "p_type"]


def _topk_sql(table, cols, k):
    return f"""SELECT * FROM (SELECT "column", value, count(*) AS count,
  CAST(row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS INTEGER) AS rank
FROM (UNPIVOT (SELECT {", ".join(cols)} FROM {table}) ON {", ".join(cols)} INTO NAME "column" VALUE value)
GROUP BY "column", value) WHERE rank <= {k}"""


@query("top_values", _topk_sql("part", PART_TEXT, 5))
def q_top_values(spark, sf_dir):
    return P.value_counts(Tables(spark, sf_dir).part, PART_TEXT, 5)


@query("dtype_counts", """SELECT data_type, CAST(columns AS BIGINT) AS columns FROM (VALUES ('bigint', 3), ('int', 1),
  ('double', 4), ('string', 2), ('timestamp_ntz', 1)) t(data_type, columns) WHERE (SELECT count(*) FROM lineitem) >= 0""")
def q_dtype_counts(spark, sf_dir):
    return P.dtype_counts(Tables(spark, sf_dir).lineitem)


@query("duplicate_count", f"""WITH {DIRTY_ORDERS}
SELECT (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates""")
def q_duplicate_count(spark, sf_dir):
    return P.duplicate_count(dirty_orders(Tables(spark, sf_dir)))


@query("stats_report_numeric", f"""SELECT "column", count(value) AS count, CAST(printf('%.6e', CAST(avg(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS mean,
  CAST(printf('%.6e', CAST(stddev_samp(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS std, CAST(printf('%.6e', CAST(min(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS min, CAST(printf('%.6e', CAST(quantile_cont(value, 0.25) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q25,
  CAST(printf('%.6e', CAST(quantile_cont(value, 0.5) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q50, CAST(printf('%.6e', CAST(quantile_cont(value, 0.75) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q75, CAST(printf('%.6e', CAST(max(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS max,
  CAST(printf('%.6e', CAST(skewness(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS skew, CAST(printf('%.6e', CAST(kurtosis(value) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS kurtosis
FROM {_li_long(LI_NUM)} GROUP BY "column" """)
def q_stats_report_numeric(spark, sf_dir):
    return sig_doubles(P.stats_report_numeric(Tables(spark, sf_dir).lineitem))


@query("stats_report_text", f"""SELECT t.*, n.nunique FROM ({_topk_sql("customer", ["c_name", "c_mktsegment"], 5)}) t
JOIN (SELECT 'c_name' AS "column", count(DISTINCT c_name) AS nunique FROM customer
      UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) n USING ("column")""")
def q_stats_report_text(spark, sf_dir):
    return P.stats_report_text(Tables(spark, sf_dir).customer)


@query("preview", """SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10""")
def q_preview(spark, sf_dir):
    return P.preview(Tables(spark, sf_dir).lineitem, 10, ["l_orderkey", "l_linenumber"])


@query("clean_answers", """SELECT doc_id, replace(CASE
  WHEN doc_id % 10 = 0 THEN '<span style=''color:red;''><b>⚠️ Gemini API quota exceeded.</b><br>You have reached your usage limit for the Gemini API.<br>Please check your <a href=''https://ai.google.dev/gemini-api/docs/rate-limits'' target=''_blank''>quota and billing details</a>.<br>Wait a minute and try again, or upgrade your plan if needed.</span>'
  WHEN doc_id % 10 = 1 THEN 'Error generating insights: connection reset'
  ELSE replace(text || ' **' || source || '**', '*', '') END, chr(10), '<br>') AS shown FROM documents""")
def q_clean_answers(spark, sf_dir):
    """Model answers made from whole documents (markdown bold added), with a quota error on
    every 10th and a network error on the next."""
    d = Tables(spark, sf_dir).documents
    m = F.col("doc_id") % 10
    err = F.when(m == 0, F.lit("429 Resource has been exhausted (e.g. check quota).")) \
        .when(m == 1, F.lit("connection reset"))
    ans = F.concat(F.col("text"), F.lit(" **"), F.col("source"), F.lit("**"))
    return d.select("doc_id", P.clean_answers(ans, err).alias("shown"))


@query("dataset_summary", f"""SELECT 'shape' AS section, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value FROM lineitem
UNION ALL SELECT 'shape', 'columns', 11.0
UNION ALL {" UNION ALL ".join(f"SELECT 'missing', '{c}', CAST(count(*) - count({c}) AS DOUBLE) FROM lineitem" for c in LI_ALL)}
UNION ALL SELECT 'describe', "column" || '.' || stat, v FROM (
  SELECT "column", unnest(['count', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max']) AS stat,
         unnest([CAST(printf('%.6e', CAST(count(value) AS DOUBLE) * 1.000000000001) AS DOUBLE), CAST(printf('%.6e', CAST(avg(value) AS DOUBLE) * 1.000000000001) AS DOUBLE), CAST(printf('%.6e', CAST(stddev_samp(value) AS DOUBLE) * 1.000000000001) AS DOUBLE), CAST(printf('%.6e', CAST(min(value) AS DOUBLE) * 1.000000000001) AS DOUBLE),
                 CAST(printf('%.6e', CAST(quantile_cont(value, 0.25) AS DOUBLE) * 1.000000000001) AS DOUBLE), CAST(printf('%.6e', CAST(quantile_cont(value, 0.5) AS DOUBLE) * 1.000000000001) AS DOUBLE),
                 CAST(printf('%.6e', CAST(quantile_cont(value, 0.75) AS DOUBLE) * 1.000000000001) AS DOUBLE), CAST(printf('%.6e', CAST(max(value) AS DOUBLE) * 1.000000000001) AS DOUBLE)]) AS v
  FROM {_li_long(LI_NUM)} GROUP BY "column")
UNION ALL SELECT 'value_counts', "column" || '=' || value, CAST(count(*) AS DOUBLE)
  FROM (UNPIVOT (SELECT l_returnflag, l_linestatus FROM lineitem) ON l_returnflag, l_linestatus
        INTO NAME "column" VALUE value) GROUP BY "column", value""")
def q_dataset_summary(spark, sf_dir):
    """The model's input summary as rows: shape, missing per column, describe, all value counts."""
    li = Tables(spark, sf_dir).lineitem
    shape = P.table_metrics(li).select(F.explode(F.array(
        F.struct(F.lit("rows").alias("item"), F.col("rows").cast("double").alias("value")),
        F.struct(F.lit("columns").alias("item"), F.col("columns").cast("double").alias("value")))).alias("x")) \
        .select(F.lit("shape").alias("section"), "x.*")
    miss = P.null_counts(li).select(F.lit("missing").alias("section"), F.col("column").alias("item"),
                                    F.col("nulls").cast("double").alias("value"))
    stats = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    desc = P.describe(li).select("column", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])).alias("x")) \
        .select(F.lit("describe").alias("section"), F.concat("column", F.lit("."), "x.stat").alias("item"),
                F.col("x.v").alias("value"))
    vc = P.value_counts(li).select(F.lit("value_counts").alias("section"),
                                   F.concat("column", F.lit("="), "value").alias("item"),
                                   F.col("count").cast("double").alias("value"))
    return shape.unionByName(miss).unionByName(sig_doubles(desc)).unionByName(vc)


@query("insight_prompt")
def q_insight_prompt(spark, sf_dir):
    """The prompt about the customers, line by line."""
    c = Tables(spark, sf_dir).customer
    log = spark.createDataFrame([(1, "Parsed nothing"), (2, "Dropped nothing")], "step int, message string")
    return P.insight_prompt(c, log, ["c_custkey"])


# ------------------------------------------------------------------------------------------
# Chart data

@query("overview", """SELECT * FROM (VALUES ('cells', (SELECT count(*) * 11 FROM lineitem)),
  ('rows', (SELECT count(*) FROM lineitem)), ('columns', 11), ('type:bigint', 3), ('type:int', 1),
  ('type:double', 4), ('type:string', 2), ('type:timestamp_ntz', 1)) t(metric, value)""")
def q_overview(spark, sf_dir):
    return V.overview(Tables(spark, sf_dir).lineitem)


HIST = LI_NUM[:V.HIST_COLS]  # the app's charts take the first columns


@query("histogram", f"""WITH long AS {_li_long(HIST)},
r AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM long GROUP BY "column"),
b AS (SELECT l."column", CAST(least(19, floor((value - lo) / CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END)) AS INTEGER) AS bin
      FROM long l JOIN r USING ("column")),
c AS (SELECT "column", bin, count(*) AS count FROM b GROUP BY ALL),
e AS (SELECT "column", CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 20) AS lo, lo + (i + 1) * ((hi - lo) / 20) AS hi
      FROM r, range(20) t(i))
SELECT e."column", e.bin, CAST(printf('%.6e', CAST(e.lo AS DOUBLE) * 1.000000000001) AS DOUBLE) AS lo, CAST(printf('%.6e', CAST(e.hi AS DOUBLE) * 1.000000000001) AS DOUBLE) AS hi, coalesce(c.count, 0) AS count
FROM e LEFT JOIN c USING ("column", bin)""")
def q_histogram(spark, sf_dir):
    return sig_doubles(V.histogram(Tables(spark, sf_dir).lineitem, HIST))


BOX = LI_NUM[:V.BOX_COLS]


@query("box_stats", f"""WITH long AS {_li_long(BOX)},
q AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM long GROUP BY "column"),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT "column", CAST(printf('%.6e', CAST(q1 AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q1, CAST(printf('%.6e', CAST(med AS DOUBLE) * 1.000000000001) AS DOUBLE) AS median, CAST(printf('%.6e', CAST(q3 AS DOUBLE) * 1.000000000001) AS DOUBLE) AS q3, CAST(printf('%.6e', CAST(lo AS DOUBLE) * 1.000000000001) AS DOUBLE) AS lower_fence,
  CAST(printf('%.6e', CAST(hi AS DOUBLE) * 1.000000000001) AS DOUBLE) AS upper_fence, CAST(printf('%.6e', CAST(min(value) FILTER (WHERE value >= lo AND value <= hi) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS whisker_low,
  CAST(printf('%.6e', CAST(max(value) FILTER (WHERE value >= lo AND value <= hi) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS whisker_high, CAST(printf('%.6e', CAST(mean AS DOUBLE) * 1.000000000001) AS DOUBLE) AS mean,
  count(*) FILTER (WHERE value < lo OR value > hi) AS outliers
FROM long JOIN f USING ("column") GROUP BY "column", q1, med, q3, lo, hi, mean""")
def q_box_stats(spark, sf_dir):
    return sig_doubles(V.box_stats(Tables(spark, sf_dir).lineitem, BOX))


@query("bar_top10", _topk_sql("part", PART_TEXT, 10))
def q_bar_top10(spark, sf_dir):
    return V.top_values(Tables(spark, sf_dir).part, PART_TEXT[:V.BAR_COLS])


@query("pie_top6", f"""SELECT "column", value, count, rank, CAST(printf('%.6e', CAST(count / sum(count) OVER (PARTITION BY "column") AS DOUBLE) * 1.000000000001) AS DOUBLE) AS share
FROM ({_topk_sql("part", ["p_name", "p_brand"], 6)})""")
def q_pie_top6(spark, sf_dir):
    return sig_doubles(V.pie(Tables(spark, sf_dir).part, PART_TEXT[:V.PIE_COLS]))


VIOLIN = LI_NUM[:V.VIOLIN_COLS]


@query("violin_density", f"""WITH long AS {_li_long(VIOLIN)},
s AS (SELECT "column", count(value) AS n, stddev_samp(value) AS sd, min(value) AS vmin, max(value) AS vmax,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM long GROUP BY "column"),
h AS (SELECT *, 1.059 * (CASE WHEN iqr > 0 THEN least(sd, iqr / 1.349) ELSE sd END) * pow(n, -0.2) AS bw FROM s),
g AS (SELECT "column", n, bw, CAST(i AS INTEGER) AS point,
             (vmin - 2 * bw) + i * (((vmax + 2 * bw) - (vmin - 2 * bw)) / 63) AS x FROM h, range(64) t(i))
SELECT g."column", g.point, CAST(printf('%.6e', CAST(g.x AS DOUBLE) * 1.000000000001) AS DOUBLE) AS x,
  CAST(printf('%.6e', CAST(sum(exp(-0.5 * pow((l.value - g.x) / g.bw, 2))) * (1.0 / (g.n * g.bw * sqrt(2 * pi()))) AS DOUBLE) * 1.000000000001) AS DOUBLE) AS density
FROM g JOIN long l USING ("column") GROUP BY g."column", g.point, g.x, g.n, g.bw""")
def q_violin_density(spark, sf_dir):
    return sig_doubles(V.violin(Tables(spark, sf_dir).lineitem, VIOLIN))


def _scatter_sql(cols, bins=20):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, "
                f"CAST(least({bins - 1}, floor(({a} - r.{a}_lo) / CASE WHEN r.{a}_hi > r.{a}_lo THEN (r.{a}_hi - r.{a}_lo) / {bins} ELSE 1.0 END)) AS INTEGER) AS bin_a, "
                f"CAST(least({bins - 1}, floor(({b} - r.{b}_lo) / CASE WHEN r.{b}_hi > r.{b}_lo THEN (r.{b}_hi - r.{b}_lo) / {bins} ELSE 1.0 END)) AS INTEGER) AS bin_b "
                f"FROM li, r")
    rng = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in cols)
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (f"WITH li AS (SELECT {sel} FROM lineitem), r AS (SELECT {rng} FROM li) "
            f"SELECT a, b, bin_a, bin_b, count(*) AS count FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL")


@query("scatter_density", _scatter_sql(LI_NUM))
def q_scatter_density(spark, sf_dir):
    return V.scatter_density(Tables(spark, sf_dir).lineitem)


# ------------------------------------------------------------------------------------------
# Unusual tables and whole rows

def _sig(e: str) -> str:
    return f"CAST(printf('%.6e', CAST({e} AS DOUBLE) * 1.000000000001) AS DOUBLE)"


@query("describe_extremes", f"""WITH t AS (SELECT CAST(l_extendedprice AS DOUBLE) * 1e-12 AS tiny, CAST(l_orderkey AS DOUBLE) * 100.0 AS big FROM lineitem),
long AS (UNPIVOT t ON tiny, big INTO NAME "column" VALUE value)
SELECT "column", count(value) AS count, {", ".join(f"{_sig(e)} AS {n}" for e, n in (
    ("avg(value)", "mean"), ("stddev_samp(value)", "std"), ("min(value)", "min"), ("quantile_cont(value, 0.25)", "q25"),
    ("quantile_cont(value, 0.5)", "q50"), ("quantile_cont(value, 0.75)", "q75"), ("max(value)", "max")))}
FROM long GROUP BY "column" """)
def q_describe_extremes(spark, sf_dir):
    """Statistics of very small and of large values (nothing is rounded on the way)."""
    li = Tables(spark, sf_dir).lineitem
    return sig_doubles(P.describe(li.select((F.col("l_extendedprice") * 1e-12).alias("tiny"), (F.col("l_orderkey") * 100.0).alias("big"))))


@query("impute_rows", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT o_orderkey, {_sig("price_gaps")} AS price_gaps, order_day FROM filled""")
def q_impute_rows(spark, sf_dir):
    plan = _orders_plan(spark, sf_dir)
    return sig_doubles(plan.fill_stage(plan.rows).select("o_orderkey", "price_gaps", "order_day"))


@query("distinct_rows", f"""WITH {DIRTY_ORDERS}, {STAGED}
SELECT o_orderkey, o_custkey, o_orderstatus, {_sig("price_gaps")} AS price_gaps, {_sig("price_outliers")} AS price_outliers,
  order_day, o_orderpriority FROM dedup""")
def q_distinct_rows(spark, sf_dir):
    return sig_doubles(_orders_plan(spark, sf_dir).rows)


@query("clean_odd_table", f"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS x,
  CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 < 4 THEN 'yes' ELSE 'no' END AS s, p_brand FROM part),
f AS (SELECT p_partkey, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM t)) AS x, coalesce(s, 'yes') AS s, p_brand FROM t),
q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b, quantile_cont(p_partkey, 0.25) AS ka, quantile_cont(p_partkey, 0.75) AS kb FROM f)
SELECT {_sig("greatest(least(CAST(p_partkey AS DOUBLE), kb + 1.5 * (kb - ka)), ka - 1.5 * (kb - ka))")} AS p_partkey,
  {_sig("greatest(least(x, b + 1.5 * (b - a)), a - 1.5 * (b - a))")} AS n_items, CASE s WHEN 'yes' THEN 1 ELSE 0 END AS in_stock, p_brand AS brand
FROM f, q""")
def q_clean_odd_table(spark, sf_dir):
    """A header with a dot and blanks, a map column (passes through) and a boolean with gaps (text
    yes/no, filled and encoded); every 50th row twice."""
    p = Tables(spark, sf_dir).part
    k = F.col("p_partkey")
    d = p.select("p_partkey", F.when(k % 7 != 0, F.col("p_size").cast("double")).alias("No. of items"),
                 F.when(k % 5 != 0, k % 5 < 4).alias("in_stock"), F.create_map(F.lit("brand"), "p_brand").alias("attributes"))
    out = C.deep_clean(d.unionByName(d.where("p_partkey % 50 = 0"))).df
    return sig_doubles(out.select("p_partkey", F.col("`No. of items`").alias("n_items"), "in_stock", F.col("attributes")["brand"].alias("brand")))


_CUST_NUM = ["c_custkey", "c_nationkey", "c_acctbal"]
_NUM_ITEMS = (("count", "count(v)"), ("mean", "avg(v)"), ("std", "stddev_samp(v)"), ("min", "min(v)"), ("q25", "quantile_cont(v, 0.25)"),
              ("q50", "quantile_cont(v, 0.5)"), ("q75", "quantile_cont(v, 0.75)"), ("max", "max(v)"), ("skew", "skewness(v)"), ("kurtosis", "kurtosis(v)"))


@query("statistical_analysis", "SELECT section, \"column\", item, CAST(printf('%.6e', CAST(number AS DOUBLE) * 1.000000000001) AS DOUBLE) AS number, text FROM (" + " UNION ALL ".join(
    [f"SELECT 'numeric' AS section, '{c}' AS \"column\", '{n}' AS item, (SELECT CAST({e} AS DOUBLE) FROM (SELECT CAST({c} AS DOUBLE) AS v FROM customer)) AS number, CAST(NULL AS VARCHAR) AS text"
     for c in _CUST_NUM for n, e in _NUM_ITEMS]
    + [f"SELECT 'correlation', '{a}', '{b}', (SELECT corr({a}, {b}) FROM customer), NULL" for a in _CUST_NUM for b in _CUST_NUM]
    + [f"SELECT 'text', '{c}', 'nunique', (SELECT count(DISTINCT {c}) FROM customer), NULL" for c in ("c_name", "c_mktsegment")]
    + [f"SELECT 'text', \"column\", 'top ' || rank, CAST(count AS DOUBLE), value FROM ({_topk_sql('customer', ['c_name', 'c_mktsegment'], 5)})"]) + ")")
def q_statistical_analysis(spark, sf_dir):
    """The statistics report in one frame: numeric part, correlations, text part."""
    return sig_doubles(P.statistical_analysis(Tables(spark, sf_dir).customer))
