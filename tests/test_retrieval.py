"""kNN and MMR against brute force with numpy (the library behaviour of the reference)."""

import numpy as np

from quarry.operators import retrieve as R
from quarry.operators import sparse as S


def _mmr_numpy(q, emb, k, lam):
    def cos(a, b):
        s = a @ b.T / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        s[~np.isfinite(s)] = 0
        return s
    qs = cos(q[None], emb)[0]
    idx = [int(np.argmax(qs))]
    while len(idx) < min(k, len(emb)):
        best, pick = -np.inf, -1
        sim = cos(emb, emb[idx])
        for i, s in enumerate(qs):
            if i in idx:
                continue
            v = lam * s - (1 - lam) * sim[i].max()
            if v > best:
                best, pick = v, i
        idx.append(pick)
    return idx


def test_knn_and_mmr_bruteforce(spark):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(300, 8))
    corpus[10] = corpus[11] * 3.0  # scaled copy: same cosine, different L2
    queries = rng.normal(size=(5, 8))
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)], "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "qid long, qvec array<double>")
    hits = R.knn(qdf, cdf, k=20).collect()
    for qi, q in enumerate(queries):
        d = ((corpus - q) ** 2).sum(axis=1)
        exp = sorted(range(len(corpus)), key=lambda i: (d[i], i))[:20]
        got = [r["vid"] for r in sorted((r for r in hits if r["qid"] == qi), key=lambda r: r["rank"])]
        assert got == exp
    cands = spark.createDataFrame([(r["qid"], r["rank"], r["vid"]) for r in hits], "qid long, rank int, vid long") \
        .join(cdf.withColumnRenamed("vec_id", "vid"), "vid")
    picked = R.mmr(cands, qdf, k=6, lambda_mult=0.25).collect()
    for qi, q in enumerate(queries):
        d = ((corpus - q) ** 2).sum(axis=1)
        order = sorted(range(len(corpus)), key=lambda i: (d[i], i))[:20]
        exp = [order[j] for j in _mmr_numpy(q, corpus[order], 6, 0.25)]
        got = [r["vid"] for r in sorted((r for r in picked if r["qid"] == qi), key=lambda r: r["mmr_rank"])]
        assert got == exp


def test_template_slots_not_replaced_in_user_text(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("{context} is mine", "ctx", "hist")], "q string, c string, h string")
    p = df.select(R.fill_template(chat_history=F.col("h"), context=F.col("c"), input=F.col("q")).alias("p")).first()["p"]
    assert p == R.TEMPLATE.replace("{chat_history}", "hist").replace("{context}", "ctx", 1).replace("{input}", "{context} is mine")


def test_knn_equal_vectors_stay_bounded(spark):
    corpus = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)] + [(5000, [1e8, 1.0]), (5001, [1e8, 1.5])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1e8, 1.4])], "qid long, qvec array<double>")
    got = {(r["qid"], r["rank"]): (r["vid"], r["distance"]) for r in R.knn(queries, corpus, k=3).collect()}
    assert [got[1, i][0] for i in (1, 2, 3)] == [0, 1, 2]
    assert got[2, 1][0] == 5001 and abs(got[2, 1][1] - 0.01) < 1e-9 and abs(got[2, 2][1] - 0.16) < 1e-9
    best = R._Nearest(np.array([[1.0, 2.0]]), 3)
    best.add(np.array([0]), np.arange(3000), np.tile([1.0, 2.0], (3000, 1)))
    assert best.v.tolist() == [[0, 1, 2]] and best.d.tolist() == [[0.0, 0.0, 0.0]]


def test_knn_unfit_vectors_and_dimensions(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 0.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.selectExpr("vec_id qid", "embedding qvec")
    got = sorted((r["qid"], r["rank"], r["vid"], r["distance"]) for r in R.knn(q, df, k=3).collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 8, 1.0), (7, 1, 7, 0.0), (8, 1, 8, 0.0), (8, 2, 1, 1.0)]
    assert R.knn(q.limit(0), df).count() == 0 and R.knn(q, df.limit(0)).count() == 0


def test_knn_blocks_and_cells(spark, monkeypatch):
    """Several query blocks and clustered corpus blocks, most of which the triangle inequality skips."""
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    corpus = np.concatenate([rng.normal(size=(400, 5)) + 40 * c for c in range(6)])
    queries = corpus[rng.integers(0, len(corpus), 30)] + 0.01
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "qid long, qvec array<double>")
    got = {(r["qid"], r["rank"]): r["vid"] for r in R.knn(qdf, cdf, k=5).collect()}
    for i, q in enumerate(queries):
        d = ((corpus - q) ** 2).sum(axis=1)
        assert [got[i, j] for j in range(1, 6)] == sorted(range(len(corpus)), key=lambda v: (d[v], v))[:5]


def test_sparse_vectors(spark):
    import collections
    import hashlib
    import math
    import re
    texts = ["The cat, the dog", None, "", "élan vital ÉLAN 12_3", "кот и пёс и кот", "the the the", "cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    tf = [collections.Counter(int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 64 for w in re.findall(r"\w+", (t or "").lower())) for t in texts]
    n = collections.Counter(t for c in tf for t in c)
    got = {r["i"]: {x["term"]: x["weight"] for x in r["embedding"]} for r in S.tfidf_embed(df, num_features=64).collect()}
    unit = {r["i"]: sum(x["weight"] ** 2 for x in r["embedding"]) for r in S.tfidf_embed(df, num_features=64, normalise=True).collect()}
    for i, c in enumerate(tf):
        want = {t: k * math.log((len(texts) + 1) / (n[t] + 1)) for t, k in c.items()}
        assert got[i].keys() == want.keys() and all(abs(got[i][t] - want[t]) < 1e-12 for t in want) and list(got[i]) == sorted(got[i])
        assert abs(unit[i] - bool(want)) < 1e-12


def test_nearest_by_terms(spark):
    """Inverted lists with bounds against all products: frequent terms, equal vectors, unfit vectors."""
    rng = np.random.default_rng(4)
    vector = lambda n: {int(t): float(w) for t, w in zip(np.minimum(rng.zipf(1.4, n), 200), rng.random(n) + 0.01, strict=True)}
    corpus = {i: vector(int(rng.integers(1, 25))) for i in range(500)}
    corpus |= {1000 + i: corpus[3] for i in range(40)}
    questions = {i: vector(8) for i in range(25)} | {100: {199: 1.0}, 101: dict(corpus[3])}
    as_rows = lambda d: [(i, sorted(v.items())) for i, v in d.items()]
    schema = "id long, v " + S.VECTOR
    cdf = spark.createDataFrame([*as_rows(corpus), (2000, None), (2001, []), (None, [(1, 9.0)])], schema).selectExpr("id vec_id", "v embedding")
    qdf = spark.createDataFrame([*as_rows(questions), (200, None), (201, []), (202, [(5000, 1.0)])], schema).selectExpr("id qid", "v qvec")
    got = {}
    for r in S.nearest_by_terms(qdf, cdf, 10).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["vid"], r["score"]))
    for q, qv in questions.items():
        dots = {i: sum(w * qv[t] for t, w in sorted(v.items()) if t in qv) for i, v in corpus.items() if qv.keys() & v.keys()}
        want = sorted(dots, key=lambda i: (-round(dots[i], 12), i))[:10]
        mine = sorted(got.get(q, []))
        assert [v for _, v, _ in mine] == want and all(abs(s - dots[v]) < 1e-12 for _, v, s in mine)
    assert not {200, 201, 202} & set(got)


def _found(rows):
    got = {}
    for r in rows:
        got.setdefault(r["qid"], []).append((r["rank"], r["vid"], round(r["score"], 12)))
    return {q: sorted(v) for q, v in got.items()}


def test_nearest_by_terms_many_blocks(spark, monkeypatch):
    """Many blocks of rows and questions, held in the tasks or joined: the same rows; ids that come twice
    count twice, in each other's question too."""
    rng = np.random.default_rng(6)
    vector = lambda n: sorted({int(t): float(w) for t, w in zip(np.minimum(rng.zipf(1.3, n), 300), rng.random(n) + 0.01, strict=True)}.items())
    corpus = [(i, vector(int(rng.integers(1, 30)))) for i in range(900)]
    corpus += [corpus[7], (7, vector(9)), *((2000 + i, corpus[11][1]) for i in range(30))]
    asked = [(i, vector(6)) for i in range(30)]
    asked += [asked[3], (4, vector(6)), (50, corpus[11][1]), (51, [(9999, 1.0)])]
    cdf = spark.createDataFrame(corpus, "id long, v " + S.VECTOR).selectExpr("id vec_id", "v embedding").repartition(3)
    qdf = spark.createDataFrame(asked, "id long, v " + S.VECTOR).selectExpr("id qid", "v qvec")
    want = {}
    for q, qv in asked:
        weight = dict(qv)
        want.setdefault(q, []).extend((-round(sum(w * weight.get(t, 0.0) for t, w in v), 12), i) for i, v in corpus if weight.keys() & dict(v).keys())
    want = {q: [(i + 1, v, -s) for i, (s, v) in enumerate(sorted(x)[:10])] for q, x in want.items() if x}
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    assert _found(S.nearest_by_terms(qdf, cdf, 10).collect()) == want
    assert _found(S.nearest_by_terms(qdf, cdf, 10, held_bytes=0).collect()) == want


def test_best_of_small_blocks():
    """Blocks of a few rows, so that thresholds, weak lists and lists without rows all occur."""
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((400, 40)) < 0.2, rng.random((400, 40)) * np.arange(1, 41), 0.0)
    dense[100:140] = dense[5]

    def block(ids, x):
        return S._Block(np.asarray(ids), (x > 0).sum(axis=1), np.nonzero(x)[1].astype(np.int32), x[x > 0])

    questions = block(range(8), dense[[0, 5, 30, 31, 32, 33, 34, 35]])
    best = S._Best(questions, 6)
    for i in range(0, 400, 13):
        best.add(questions, block(range(i, min(400, i + 13)), dense[i:i + 13]))
    for q, qv in enumerate(dense[[0, 5, 30, 31, 32, 33, 34, 35]]):
        score = [sum(a * b for a, b in zip(x[x > 0], qv[x > 0], strict=True)) for x in dense]
        want = sorted((i for i in range(400) if score[i]), key=lambda i: (-score[i], i))[:6]
        assert best.vid[q].tolist() == want and best.score[q].tolist() == [score[i] for i in want]


def test_sparse_retrieval_writes_little(spark):
    """Texts and counts are written once: no vectors, no postings, neither as tables nor by a shuffle."""
    import pathlib
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = [(i, " ".join(words[np.minimum(rng.zipf(1.2, 80), 3000) - 1])) for i in range(4000)]
    texts = spark.createDataFrame(rows, "vec_id long, content string").selectExpr("*", "'t' title", "1 chunk_id", "'s' source")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shared = pathlib.Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent

    def written():
        own = files.getAllFiles()
        return sum(f.stat().st_size for f in shared.rglob("*.parquet")) + sum(own.apply(i).length() for i in range(own.size()))

    start = written()
    R.stored(texts, "plain").count()
    plain = written() - start
    start = written()
    emb = S.tfidf_embed(texts, num_features=1 << 10, normalise=True)
    found = R.retrieve(emb.where("vec_id < 5").selectExpr("vec_id qid", "embedding qvec"), emb).collect()
    assert written() - start < 2.5 * plain
    assert {r["qid"] for r in found} == set(range(5)) and all(r["content"] == rows[r["qid"]][1] for r in found if r["mmr_rank"] == 1)
