"""Local stand-in for the driver's correctness gate: Spark query vs DuckDB oracle SQL on the same
parquet tables, compared as order-insensitive multisets of normalised rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(norm(r[i]) for i in idx) for r in data), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    scols, srows = spark_rows(df)
    if sql is None:
        return {"name": name, "rows": len(srows), "oracle": None}
    dcols, drows = duck_rows(con, sql)
    res = {"name": name, "rows": len(srows), "oracle_rows": len(drows),
           "cols_match": scols == dcols, "values_match": srows == drows}
    if scols != dcols:
        res["cols"] = (scols, dcols)
    elif srows != drows:
        s_only = [r for r in srows if r not in set(drows)][:3]
        d_only = [r for r in drows if r not in set(srows)][:3]
        res["diff"] = (s_only, d_only)
    return res
