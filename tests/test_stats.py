"""Statistics and cleaning against pandas on small literal frames (edge inputs of SURVEY §5)."""

import math

import numpy as np
import pandas as pd

from quarry.functions import stats as S
from quarry.operators import charts as V
from quarry.operators import clean as C
from quarry.operators import profile as P


def close(a, b, tol=1e-9):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def test_quantiles_exact(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 2.5)])  # a hot value: a third of rows
    df = spark.createDataFrame([(float(v), float(v) * 2, None) for v in vals], "`a.b c` double, b double, e double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = S.quantile_map(df, ["a.b c", "b", "e"], probs)
    for c, f in (("a.b c", 1), ("b", 2)):
        assert all(close(got[(c, p)], float(pd.Series(vals * f).quantile(p))) for p in probs)
    assert all(got[("e", p)] is None for p in probs) and S.quantile_map(df, [], probs) == {}


def test_quantiles_of_few_values_make_no_rows(spark, monkeypatch):
    # each bracket's ends are values of the column: counting settles every rank, no value becomes a row
    stored, names = S.stored, []
    monkeypatch.setattr(S, "stored", lambda df, name: names.append(name) or stored(df, name))
    rows = [(float(i % 10), i % 4, -0.0) for i in range(4000)] + [(None, None, None), (math.nan, 3, 0.0)]
    df = spark.createDataFrame(rows, "a double, b int, z double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = S.quantile_map(df, ["a", "b", "z"], probs)
    assert names == []
    for i, c in enumerate("abz"):
        own = pd.Series([float(r[i]) for r in rows if r[i] is not None and not math.isnan(r[i])])
        assert all(close(got[(c, p)], float(own.quantile(p))) for p in probs)
    assert all(math.copysign(1, got[("z", p)]) == 1 for p in probs)
    # values strictly between the ends become rows, once each, not those below
    wide = spark.range(200000).selectExpr("cast(id as double) as v", "cast(199999 - id as double) as w")
    sizes = []
    monkeypatch.setattr(S, "stored", lambda df, name: (out := stored(df, name), sizes.append(out.agg({"cnt": "sum"}).first()[0]))[0])
    got = S.quantile_map(wide, ["v", "w"], [0.25, 0.5, 0.75])
    assert [got[c, p] for c in "vw" for p in (0.25, 0.5, 0.75)] == [49999.75, 99999.5, 149999.25] * 2
    assert sizes and max(sizes) < 0.1 * 400000
    # ranks outside their brackets are not found there, those at the ends and between are
    x = {c: wide[c] for c in "vw"}
    assert S._between(wide, x, {("v", 5): (5.0, 7.0), ("v", 6): (5.0, 7.0), ("v", 7): (6.0, 7.0), ("v", 8): (5.0, 7.0), ("w", 1): (4.0, 9.0)}) == {
        ("v", 5): 5.0, ("v", 6): 6.0, ("v", 7): 7.0}


def test_no_number_columns_and_small_values(spark):
    text = spark.createDataFrame([("a",), ("b",)], "t string")
    assert P.describe(text).count() == P.skew_kurtosis(text).count() == P.corr_matrix(text).count() == 0
    assert V.histogram(text).count() == V.box_stats(text).count() == V.violin(text).count() == V.scatter_density(text).count() == 0
    assert P.stats_report_numeric(text).count() == 0 and P.statistical_analysis(text).count() > 0
    tiny = spark.createDataFrame([(i * 1e-9,) for i in range(11)], "`x.y` double")
    r = P.describe(tiny).first()
    assert close(r["mean"], 5e-9) and close(r["q25"], 2.5e-9) and close(r["max"], 1e-8)
    big = spark.createDataFrame([(float(i * 10**6),) for i in range(100)], "x double")
    assert all(r["density"] > 0 for r in V.violin(big).collect())
    s = {(r["section"], r["name"]): r["value"] for r in P.dataset_summary(tiny, spark.createDataFrame([(1, "m")], "step int, message string"), ["x.y"]).collect()}
    assert s["shape", "shape"] == "11 x 1" and s["types", "x.y"] == "double" and s["missing", "x.y"] == "0" and s["log", "1"] == "m"


def test_clean_odd_columns(spark):
    rows = [(i, None if i % 3 == 0 else i % 2 == 0, {"k": i % 4}, float(i % 4)) for i in range(40)] * 2
    df = spark.createDataFrame(rows, "id int, `is ok?` boolean, m map<string,int>, `No. of items` double")
    plan = C.fit_clean(df)
    assert plan.duplicates == 40 and "is ok?" in plan.string_cols and plan.labels["is ok?"] == ["no", "yes"]
    out = plan.apply(df).collect()
    assert len(out) == 40 and all(r["m"]["k"] == int(r["No. of items"]) and r["is ok?"] in (0, 1) for r in out)
    new = spark.createDataFrame([(1, "zz"), (2, "yes")] * 3, "id int, t string")
    p2 = C.fit_clean(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, t string"))
    assert {r["t"] for r in p2.apply(new).collect()} == {2} and {r["label"] for r in p2.unseen_labels(new).collect()} == {"zz", "yes"}


def test_skew_kurtosis_and_constant(spark):
    data = [(float(x), 1.0) for x in [1, 2, 2, 3, 7, 9, 10, 10, 10, 25]]
    df = spark.createDataFrame(data, "x double, c double")
    got = {r["column"]: r for r in P.skew_kurtosis(df).collect()}
    s = pd.Series([d[0] for d in data])
    assert close(got["x"]["skew"], s.skew(), 1e-9)
    assert close(got["x"]["kurtosis"], s.kurt(), 1e-9)
    assert got["c"]["skew"] == 0.0 and got["c"]["kurtosis"] == 0.0


def test_corr_pairwise_and_constant(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 5.0, 7.0], "b": [2.0, 1.0, 3.0, None, 8.0, 9.0],
                        "k": [3.0] * 6})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "a double, b double, k double")
    got = {(r["a"], r["b"]): r["r"] for r in P.corr_matrix(df).collect()}
    exp = pdf.corr()
    assert close(got[("a", "b")], exp.loc["a", "b"], 1e-9)
    assert got[("a", "k")] is None and got[("k", "k")] is None


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert S.modes(df, ["v"]).first()["mode"] == "a"


def test_clean_edges(spark):
    # 8 of 10 leading values are dates (> 0.7: candidate); 7 of 10 are not (not > 0.7)
    dates8 = ["2024-01-0%d" % (i % 9 + 1) if i < 8 else "n.a." for i in range(10)] + ["2024-02-01"] * 10
    dates7 = ["2024-01-0%d" % (i % 9 + 1) if i < 7 else "n.a." for i in range(10)] + ["2024-02-01"] * 10
    half = [None if i % 2 == 0 else "v%d" % (i % 3) for i in range(20)]        # exactly 50 % missing: kept
    cats19 = ["c%02d" % (i % 19) for i in range(20)]                           # 19 distinct: encoded
    cats20 = ["c%02d" % (i % 20) for i in range(20)]                           # 20 distinct: not encoded
    num = [float(i) for i in range(19)] + [1000.0]                             # one outlier
    rows = list(zip(range(20), dates8, dates7, half, cats19, cats20, num, ["same"] * 20))
    df = spark.createDataFrame(rows, "k int, d8 string, d7 string, half string, c19 string, c20 string, x double, "
                                     "const string")
    plan = C.fit_clean(df, date_sample_by=["k"])
    assert plan.date_cols == ["d8"]
    assert "const" in plan.drop_cols and "half" not in plan.drop_cols
    assert "c19" in plan.labels and "c20" not in plan.labels
    q1, q3 = pd.Series(num).quantile(0.25), pd.Series(num).quantile(0.75)
    lo, hi = plan.fences["x"]
    assert close(lo, q1 - 1.5 * (q3 - q1)) and close(hi, q3 + 1.5 * (q3 - q1))
    assert plan.outliers >= 1
    out = plan.apply(df).collect()
    assert all(r["x"] <= hi for r in out)
    assert all(r["half"] is not None for r in out)  # filled with the mode


def test_limiter_edges(spark):
    from quarry.operators.conversation import rate_limit
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    ev = [(1, "u", t0, "a"), (2, "u", t0 + h, "b"), (3, "u", t0 + 2 * h, "b"), (4, "u", t0 + 3 * h, "c"),
          (5, "u", t0 + 4 * h, "d"), (6, "u", t0 + 6 * h, "e"),  # first upload aged exactly 6 h: forgotten
          (7, "u", t0 + 6 * h + dt.timedelta(minutes=1), "f")]
    df = spark.createDataFrame(ev, "event_id long, session_id string, ts timestamp_ntz, name string")
    got = {r["event_id"]: (r["status"], r["uploads_left"]) for r in rate_limit(df).collect()}
    assert got[1] == ("accepted", 2) and got[2] == ("accepted", 1) and got[3] == ("repeat", 1)
    assert got[4] == ("accepted", 0) and got[5] == ("refused", 0)
    assert got[6] == ("accepted", 0)  # t0 dropped at exactly 6 h, so 2 remain -> accept
    assert got[7] == ("refused", 0)


def test_insight_prompt(spark):
    from quarry.operators import profile as P
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i == 3 else float(i)) for i in range(6)], "k long, t string, v double")
    log = spark.createDataFrame([(i, f"step {i}") for i in range(1, 12)], "step int, message string")
    rows = P.insight_prompt(df, log, ["k"]).orderBy("position").collect()
    lines = [r["line"] for r in rows]
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))
    assert "\n".join(lines).startswith(P.INSIGHT_REQUEST + "\nDataset Overview:\n- Shape:\n6, 3\n- Data types:\nk: bigint\nt: string\nv: double\n- Missing values:\nk: 0\nt: 0\nv: 1\n- Numeric summary:\n")
    at = lines.index("- Categorical summary:")
    assert "v.mean: 2.4" in lines[:at] and lines[at + 1:at + 3] == ["t=a: 3", "t=b: 3"]
    assert lines[at + 3:at + 15] == ["- Cleaning Operations Performed:", *[f"step {i}" for i in range(1, 12)]]
    assert lines[at + 15:] == ["- Sample data:", *['{"k":%d,"t":"%s"%s}' % (i, "ab"[i % 2], "" if i == 3 else f',"v":{float(i)}') for i in range(5)]]
    assert P.insight_prompt(df).count() == len(rows) - 12
