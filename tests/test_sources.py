"""CSV source: UTF-8 and latin-1 files in one folder, missing-value tokens, inferred types."""

import os
import tempfile

from quarry.sources.files import read_table


def test_read_table_encoding_fallback_and_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="quarry-csv-test-")
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write("name,qty,note\nCafé,1,NA\nNaïve,2,ok\n".encode("utf-8"))
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("name,qty,note\nCrème,3,null\nSoirée,4,\n".encode("latin-1"))  # not valid UTF-8
    df = read_table(spark, d)
    rows = sorted((r["name"], r["qty"], r["note"]) for r in df.collect())
    assert rows == [("Café", 1, None), ("Crème", 3, None), ("Naïve", 2, "ok"), ("Soirée", 4, None)]
    assert dict(df.dtypes)["qty"] == "bigint"


def test_csv_quotes_breaks_gaps_and_dates(spark):
    import pandas as pd
    from quarry.sources.files import plain_text, write_csv
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    d = tempfile.mkdtemp(prefix="quarry-csv-test-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write('No. of,note,day,flag,x\n1,"He said ""hi"", ok",2024-01-01,True,1e3\nNA,"two\nlines",2024-01-02,False,.5\n3,plain,,True,-2\n')
    df = read_table(spark, d)
    assert dict(df.dtypes) == {"No. of": "double", "note": "string", "day": "string", "flag": "boolean", "x": "double"}
    rows = {r["note"]: r for r in df.collect()}
    assert set(rows) == {'He said "hi", ok', "two\nlines", "plain"} and rows["plain"]["No. of"] == 3.0 and rows["plain"]["day"] is None
    out = write_csv(df.coalesce(1), tempfile.mkdtemp(prefix="quarry-csv-test-"))
    back = pd.concat(pd.read_csv(os.path.join(out, x)) for x in os.listdir(out) if x.endswith(".csv"))
    assert set(back["note"]) == set(rows)
    v = [12345678.9, 0.1, 1.0, -2.5, 1e15, 1e20, 1e-7, None]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in v], "x double").select(plain_text(F.col("x"), T.DoubleType()).alias("t")).collect()]
    assert got[:5] == ["12345678.9", "0.1", "1.0", "-2.5", "1000000000000000.0"] and got[7] is None


def test_columns_by_name_and_large_integers(spark):
    from quarry.sources.files import header_names
    assert header_names('a,a,,"x, y",a.1,a') == ["a", "a.1", "Unnamed: 2", "x, y", "a.1.1", "a.2"] and header_names('a,"b') is None
    d = tempfile.mkdtemp(prefix="quarry-csv-test-")
    for name, text in (("a.csv", "id,name,big\n3,z,9223372036854775807\n"), ("b.csv", "name,id,big\ny,4,9223372036854775806\n"), ("c.csv", "﻿id,extra\n5,q\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    df = read_table(spark, d)
    assert {r["id"]: (r["name"], r["extra"]) for r in df.collect()} == {3: ("z", None), 4: ("y", None), 5: (None, "q")}
    d = tempfile.mkdtemp(prefix="quarry-csv-test-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("a,a,big,huge\n1,2,9223372036854775807,92233720368547758070\n3,4,-9223372036854775808,5\n")
    df = read_table(spark, d)
    assert df.columns == ["a", "a.1", "big", "huge"] and dict(df.dtypes)["big"] == "bigint" and dict(df.dtypes)["huge"] == "decimal(38,0)"
    assert sorted((r["a"], r["a.1"], r["big"], int(r["huge"])) for r in df.collect()) == [
        (1, 2, 2**63 - 1, 92233720368547758070), (3, 4, -2**63, 5)]
