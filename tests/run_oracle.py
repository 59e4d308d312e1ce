"""Run queries against their oracle SQL: python tests/run_oracle.py [sf_dir] [key ...]"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.session import build_session  # noqa: E402
from tests.oracle_compare import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    if os.environ.get("QUARRY_VANILLA"):  # a session with Spark defaults, as a driver might use
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    keys = args or sorted(qs)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": k, "error": repr(e)[:600]}
        r["sec"] = round(time.time() - t0, 2)
        ok = r.get("values_match", r.get("oracle", 1) is None and "error" not in r)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + json.dumps(r, default=str)[:1500], flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main()
