"""Running sums and text pieces with one group that holds a third of all rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions import running as R
from quarry.operators import extract as X


def rows(seed=3, n=2000):
    r = random.Random(seed)
    out = [("hot" if r.random() < 0.34 else r.choice(["a", "b", "c", None, ""]), i, r.choice(["x", "yy", "", "é" * 30, "z" * 400])) for i in range(n)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("partitions", [1, 16])
def test_running_sum(spark, monkeypatch, partitions):
    seen = []
    monkeypatch.setattr(R, "stored", lambda df, name, keep=R.stored: seen.append(keep(df, name)) or seen[-1])
    data = rows()
    df = spark.createDataFrame(data, "g string, i int, part string")
    got = {r["i"]: r["s"] for r in R.running_sum(df, "g", ["i"], F.length("part"), "s", partitions).collect()}
    total = defaultdict(int)
    for g, i, t in sorted(data, key=lambda x: x[1]):
        total[g] += len(t)
        assert got[i] == total[g]
    assert len(got) == len(data) and R.running_sum(df.limit(0), "g", ["i"], F.lit(1), "s").count() == 0
    if partitions > 1:
        assert seen[0].where("g = 'hot'").select("part_").distinct().count() >= 4


def test_numbers_and_pieces(spark):
    data = rows(5)
    df = spark.createDataFrame(data, "source string, page_id int, content string")
    numbers = defaultdict(list)
    for r in X.number_pages(df).orderBy("page_id").collect():
        numbers[r["source"]].append(r["listing_no"])
    assert all(v == list(range(1, len(v) + 1)) for v in numbers.values())
    whole, pieces = defaultdict(list), defaultdict(list)
    for g, i, t in sorted(data, key=lambda x: x[1]):
        whole[g].append(t)
    for r in R.text_pieces(df, "source", ["page_id"], F.col("content"), "\n", 500, 8).orderBy("piece").collect():
        pieces[r["source"]].append((r["piece"], r["content"]))
    for g, texts in whole.items():
        assert [k for k, _ in pieces[g]] == list(range(len(pieces[g]))) and "\n".join(c for _, c in pieces[g]) == "\n".join(texts)
        assert max(len(c) for _, c in pieces[g]) < 500 + 401
