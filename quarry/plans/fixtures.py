"""Dirty inputs made from the driver tables by fixed expressions, identical in Spark and in the
oracle SQL. Dirt is injected into whole tables (gaps, outliers, text dates, duplicate rows); no
table is filtered down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Tables

DIRTY_ORDERS_COLS = """o_orderkey, o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_gaps,
    CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price_outliers,
    CASE WHEN o_orderkey % 20 = 0 THEN 'n.a.' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_day,
    CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS sparse_flag,
    'same' AS constant_col,
    o_orderpriority"""

# every order, plus a second copy of every 50th order (duplicate rows)
DIRTY_ORDERS = f"""dirty AS (SELECT {DIRTY_ORDERS_COLS} FROM orders
  UNION ALL SELECT {DIRTY_ORDERS_COLS} FROM orders WHERE o_orderkey % 50 = 0)"""

DIRTY_PARTS = """dparts AS (SELECT p_partkey, concat('  ', upper(p_name), '! ') AS p_name, p_brand, p_type,
    p_size, p_retailprice,
    CASE p_partkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'true' WHEN 2 THEN 'No' WHEN 3 THEN '0' ELSE 'none' END AS in_stock
  FROM part)"""


def dirty_orders(t: Tables) -> DataFrame:
    o = t.orders
    k = F.col("o_orderkey")

    def cols(df):
        return df.select(
            "o_orderkey", "o_custkey", "o_orderstatus",
            F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("price_gaps"),
            F.when(k % 97 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("price_outliers"),
            F.when(k % 20 == 0, F.lit("n.a.")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_day"),
            F.when(k % 3 == 0, F.lit("x")).alias("sparse_flag"),
            F.lit("same").alias("constant_col"),
            "o_orderpriority")

    return cols(o).unionByName(cols(o.filter(k % 50 == 0)))


def dirty_parts(t: Tables) -> DataFrame:
    p = t.part
    m = F.col("p_partkey") % 5
    return p.select(
        "p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit("! ")).alias("p_name"), "p_brand", "p_type",
        "p_size", "p_retailprice",
        F.when(m == 0, "Y").when(m == 1, "true").when(m == 2, "No").when(m == 3, "0").otherwise("none").alias("in_stock"))


# SQL twins of the text helpers
def sql_normalise(x: str) -> str:
    inner = (f"regexp_replace(lower(regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')), "
             f"'[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")
    return f"nullif({inner}, 'nan')"


def sql_standardise(x: str) -> str:
    return (f"CASE WHEN {x} IN ('yes', 'y', 'true', '1') THEN 'yes' WHEN {x} IN ('no', 'n', 'false', '0') THEN 'no' "
            f"WHEN {x} IN ('nan', 'none', 'null', '') THEN NULL ELSE {x} END")


def sql_clean_text(x: str) -> str:
    return sql_standardise(sql_normalise(x))


SQL_PARSE_DATE = ("CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') "
                  "THEN try_strptime({x}, '%Y-%m-%d') END")


def sql_parse_date(x: str) -> str:
    return SQL_PARSE_DATE.format(x=x)
