"""Retrieval and prompt building: exact kNN, maximal marginal relevance, metadata join, context
stuffing, template filling and the answer step.

kNN never materialises query x corpus pairs as rows: query blocks meet cells of corpus blocks as
matrices, blocks that the triangle inequality rules out are skipped, and a cell emits only its top-k per
query; a per-query top-k over those candidates finishes the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.sparse import nearest_by_terms
from quarry.session import broadcast_if_small, stored

# Retrieval defaults and the prompt template of the assistant.
FETCH_K = 20
MMR_K = 6
MMR_LAMBDA = 0.25
DOC_SEPARATOR = "\n\n"
NO_RESPONSE = "No response"
TEMPLATE = """
        You are a helpful AI assistant who specializes in data analysis. Your primary goal is to assist with topics related to data analysis, including (but not limited to): data cleaning, visualization, statistical analysis, machine learning for analytics, tools like Python, SQL, Excel, and business intelligence.

        If the user's input is clearly unrelated to data analysis (e.g., topics like cooking, history, movies, etc.), politely respond with:
        "I specialize in data analysis. Feel free to ask me anything related to that!"

        If the input is vague or general (e.g., “What do you know?” or “Tell me something interesting”), you can steer the conversation by briefly responding and guiding it toward data analysis, like:
        "I know quite a bit about data analysis! Would you like to explore a topic like data cleaning, visualization, or tools like Python and SQL?"

        Do not attempt to answer unrelated questions in detail.
        Chat History:
        {chat_history}  
        
        Context:
        {context}

        Input:
        {input}

        Answer:"""
SLOTS = ("chat_history", "context", "input")

# Queries and bytes of a query block, bytes of the corpus blocks that meet it in one task, rows of a
# corpus block, cells (queries x corpus rows) scored at once.
QUERY_BLOCK, QUERY_BLOCK_BYTES = 4096, 16 << 20
CELL_BYTES = 64 << 20
SCORE_CELLS = 1 << 21

_BLOCK = "dim int, ids binary, vecs binary"
_BALL = _BLOCK + ", centre binary, radius double"


def _whole(vec: Column) -> Column:
    """Vectors that take part: not null, not empty, all components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def _matrices(batches: Iterator[pa.RecordBatch], rows_of: Callable[[int], int]):
    """(dimension, ids, matrix) of rows of equal dimension, at most ``rows_of(dimension)`` at once."""
    for b in batches:
        vecs = b.column(1)
        size = np.diff(vecs.offsets.to_numpy())
        flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        at = vecs.offsets.to_numpy().astype(np.int64) - vecs.offsets[0].as_py()
        ids = b.column(0).to_numpy()
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            for k in range(0, len(rows), rows_of(int(dim))):
                part = rows[k:k + rows_of(int(dim))]
                yield int(dim), ids[part], flat[at[part][:, None] + np.arange(dim)]


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, ids, x in _matrices(batches, lambda d: max(1, min(QUERY_BLOCK, QUERY_BLOCK_BYTES // (8 * d)))):
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "vecs": [x.tobytes()]})


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus rows around pivots: rows spread evenly over a batch are the pivots, each row goes to its
    nearest, and a block carries its centre and radius."""
    for dim, ids, x in _matrices(batches, lambda d: max(64, min(8192, (8 << 20) // (8 * d)))):
        pivots = x[np.linspace(0, len(x) - 1, max(1, min(32, len(x) // 64))).astype(np.int64)]
        d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (x @ pivots.T)
        nearest = d.argmin(axis=1)
        out: dict[str, list] = {"dim": [], "ids": [], "vecs": [], "centre": [], "radius": []}
        for p in np.unique(nearest):
            own = np.flatnonzero(nearest == p)
            centre = x[own].mean(axis=0)
            for name, value in zip(out, (dim, ids[own].tobytes(), x[own].tobytes(), centre.tobytes(),
                                         float(np.sqrt(((x[own] - centre) ** 2).sum(axis=1).max()))), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict({**out, "dim": pa.array(out["dim"], pa.int32())})


class _Nearest:
    """The k nearest corpus rows of each query so far, by (distance, id). Equal vectors never pile up:
    after each step only k of them stay."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.qn = (queries * queries).sum(axis=1)
        self.d, self.v = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows x for the queries ``who``. A matrix product gives the distances; those near the k-th are
        recomputed from the differences, which keeps all digits."""
        xn = (x * x).sum(axis=1)
        d = self.qn[who, None] + xn[None, :] - 2.0 * (self.q[who] @ x.T)
        slack = 1e-12 * (self.qn[who, None] + xn[None, :]) + 1e-300
        rough = np.concatenate([self.d[who], d + slack], axis=1)
        kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1]
        qi, xi = np.nonzero(d - slack <= kth[:, None])
        exact = np.full(d.shape, np.inf)
        for i in range(0, len(qi), 1 << 16):
            a, c = qi[i:i + (1 << 16)], xi[i:i + (1 << 16)]
            exact[a, c] = ((self.q[who[a]] - x[c]) ** 2).sum(axis=1)
        all_d = np.concatenate([self.d[who], exact], axis=1)
        all_v = np.concatenate([self.v[who], np.broadcast_to(ids, exact.shape)], axis=1)
        order = np.lexsort((all_v, all_d), axis=-1)[:, :self.k]
        self.d[who], self.v[who] = np.take_along_axis(all_d, order, axis=1), np.take_along_axis(all_v, order, axis=1)


def _cell(k: int):
    """A query block against the corpus blocks of one cell, nearest blocks first. Rows of a block are at
    least |query - centre| - radius away (triangle inequality): queries whose k-th is nearer skip it."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        query = next(r for r in rows if r["radius"] is None)
        qids, dim = np.frombuffer(query["ids"], np.int64), query["dim"]
        best = _Nearest(np.frombuffer(query["vecs"]).reshape(-1, dim), k)
        balls = [r for r in rows if r["radius"] is not None]
        if balls:
            centres = np.stack([np.frombuffer(r["centre"]) for r in balls])
            gap = np.stack([np.sqrt(((best.q - c) ** 2).sum(axis=1)) for c in centres], axis=1)
            gap = gap * (1 - 1e-9) - np.array([r["radius"] for r in balls]) * (1 + 1e-9)
            for j in np.argsort(gap.min(axis=0), kind="stable"):
                who = np.flatnonzero(np.maximum(gap[:, j], 0.0) <= np.sqrt(best.d[:, -1]))
                ids, x = np.frombuffer(balls[j]["ids"], np.int64), np.frombuffer(balls[j]["vecs"]).reshape(-1, dim)
                step = max(1, SCORE_CELLS // max(1, len(who)))
                for a in range(0, len(ids) if len(who) else 0, step):
                    best.add(who, ids[a:a + step], x[a:a + step])
        qi, ci = np.nonzero(np.isfinite(best.d))
        return pa.table({"qid": qids[qi], "vid": best.v[qi, ci], "distance": best.d[qi, ci]})

    return run


def knn(queries: DataFrame, corpus: DataFrame, k: int = FETCH_K, qid: str = "qid", qvec: str = "qvec",
        vid: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Exact k nearest corpus rows per query by squared L2 (RET-1): ``(qid, rank, vid, distance)``,
    rank 1 = nearest, ties by id. Vectors that are null, empty or hold null or non-finite components
    take no part; a query meets vectors of its own dimension only.

    Query blocks are rows, joined with cells of corpus blocks (a cell's bytes are bounded); a task
    holds one query block and one cell. Nothing of either side passes through the driver."""
    q = queries.where(_whole(F.col(qvec)) & F.col(qid).isNotNull()).select(
        F.col(qid).cast("bigint").alias("id"), F.col(qvec).cast("array<double>").alias("v"))
    c = corpus.where(_whole(F.col(vec)) & F.col(vid).isNotNull()).select(F.col(vid).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    blocks = stored(q.repartition(max(1, -(-q.count() // QUERY_BLOCK)), "id").mapInArrow(_query_blocks, _BLOCK)
                    .withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    balls = stored(c.mapInArrow(_balls, _BALL), "corpus-blocks")
    cells = balls.agg(F.sum(F.octet_length("vecs") + F.octet_length("ids") + F.octet_length("centre")).alias("b")).first()["b"] or 0
    cells = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // CELL_BYTES))
    own = F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int")
    sent = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "dim", "ids", "vecs",
                         F.lit(None).cast("binary").alias("centre"), F.lit(None).cast("double").alias("radius"))
    met = balls.withColumn("cell", own).join(broadcast_if_small(blocks.select("block", "dim")), "dim").select(sent.columns)
    found = sent.unionByName(met).groupBy("block", "cell").applyInArrow(_cell(k), "qid bigint, vid bigint, distance double")
    w = Window.partitionBy("qid").orderBy("distance", "vid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("qid", F.col("rank").cast("int").alias("rank"), "vid", "distance")


def _dense(vectors: list) -> np.ndarray:
    """Rows of a matrix from vectors, or from sparse ones over the terms that they hold."""
    if not any(len(v) and isinstance(v[0], dict) for v in vectors):
        return np.array([np.asarray(v, np.float64) for v in vectors]) if any(len(v) for v in vectors) else np.zeros((len(vectors), 1))
    terms = {t: i for i, t in enumerate(sorted({x["term"] for v in vectors for x in v}))}
    out = np.zeros((len(vectors), len(terms)))
    for i, v in enumerate(vectors):
        for x in v:
            out[i, terms[x["term"]]] = x["weight"]
    return out


def _mmr_group(k: int, lam: float):
    """MMR of one query's candidates (at most ``fetch_k`` rows) with numpy."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["rank"])
        both = _dense([*(r["e"] for r in rows), rows[0]["qv"]])
        norm = np.linalg.norm(both, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # elementwise, not as a matrix product: equal vectors get equal values to the last digit
            cos = (both[:, None, :] * both[None, :, :]).sum(axis=2) / np.outer(norm, norm)
        cos[~np.isfinite(cos)] = 0.0
        qs, sim = cos[-1, :-1], cos[:-1, :-1]
        chosen = [int(np.argmax(qs))]
        while len(chosen) < min(k, len(rows)):
            score = lam * qs - (1 - lam) * sim[:, chosen].max(axis=1)
            score[chosen] = -np.inf
            chosen.append(int(np.argmax(score)))  # first maximum wins ties
        return pa.table({"qid": pa.array([rows[0]["qid"]] * len(chosen), pa.int64()), "mmr_rank": pa.array(range(1, len(chosen) + 1), pa.int32()),
                         "vid": pa.array([rows[i]["vid"] for i in chosen], pa.int64())})

    return run


def mmr(cands: DataFrame, queries: DataFrame, k: int = MMR_K, lambda_mult: float = MMR_LAMBDA,
        qid: str = "qid", qvec: str = "qvec", vid: str = "vid", vec: str = "embedding", rank: str = "rank") -> DataFrame:
    """Maximal marginal relevance (RET-2) over each query's candidates (already bounded to
    ``fetch_k`` by the search): first the candidate most cosine-similar to the query, then
    repeatedly the argmax of ``lambda * cos(q, i) - (1 - lambda) * max cos(i, chosen)``; the
    earlier candidate wins ties. Dense or sparse vectors. Returns ``(qid, mmr_rank, vid)``.

    One ``applyInArrow`` group per query (at most ``fetch_k`` rows, so a group is bounded by
    construction)."""
    c = cands.select(F.col(qid).cast("bigint").alias("qid"), F.col(rank).alias("rank"),
                     F.col(vid).cast("bigint").alias("vid"), F.col(vec).alias("e"))
    j = c.join(queries.select(F.col(qid).cast("bigint").alias("qid"), F.col(qvec).alias("qv")), "qid")
    return j.groupBy("qid").applyInArrow(_mmr_group(k, float(lambda_mult)), "qid bigint, mmr_rank int, vid bigint")


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = MMR_K, fetch_k: int = FETCH_K, lambda_mult: float = MMR_LAMBDA,
             qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """Passages for questions (RET-3): the ``fetch_k`` nearest rows of ``corpus(vec_id, embedding,
    content, title, chunk_id, source)``, of which MMR keeps ``k``:
    ``(qid, mmr_rank, content, title, chunk_id, source)``. Dense vectors are searched by distance,
    sparse ones (``sparse.tfidf_embed``) by inner product over inverted lists. Rows of the corpus are
    joined twice, both times to at most ``fetch_k`` ids for each question."""
    is_sparse = "struct" in corpus.schema["embedding"].dataType.simpleString()
    hits = (nearest_by_terms if is_sparse else knn)(queries, corpus, fetch_k, qid, qvec)
    hits = stored(hits.select("qid", "rank", "vid"), "hits")
    cands = corpus.select(F.col("vec_id").cast("bigint").alias("vid"), "embedding").join(broadcast_if_small(hits), "vid")
    picked = stored(mmr(cands, queries, k, lambda_mult, qid, qvec), "picked")
    texts = corpus.select(F.col("vec_id").cast("bigint").alias("vid"), "content", "title", "chunk_id", "source")
    return texts.join(broadcast_if_small(picked), "vid").select("qid", "mmr_rank", "content", "title", "chunk_id", "source")


def stuff_context(hits: DataFrame, key: str = "qid", order: str = "mmr_rank", content: str = "content",
                  sep: str = DOC_SEPARATOR) -> DataFrame:
    """All retrieved texts of a query joined by a blank line, in rank order (RET-4)."""
    esc = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return hits.groupBy(key).agg(
        F.expr(f"listagg({content}, '{esc}') WITHIN GROUP (ORDER BY {order})").alias("context"))


def fill_template(template: str = TEMPLATE, **slots: Column) -> Column:
    """Template with ``{chat_history}``, ``{context}``, ``{input}`` filled in one ``concat``; the
    template is split once, so slot names inside user text are never replaced (PRM-1, PRM-2)."""
    pieces = re.split(r"\{(" + "|".join(SLOTS) + r")\}", template)
    parts = []
    for i, p in enumerate(pieces):
        if i % 2 == 0:
            if p:
                parts.append(F.lit(p))
        else:
            parts.append(F.coalesce(slots[p].cast("string"), F.lit("")))
    return F.concat(*parts)


def answer(df: DataFrame, prompt: str, fn: Callable[[list[str]], list[str | None]],
           out: str = "answer") -> DataFrame:
    """Run the caller's batch model on a prompt column (PRM-3); a missing answer becomes
    ``No response``. The model is called once per Arrow batch inside the executors."""
    schema = T.StructType(df.schema.fields + [T.StructField("_raw", T.StringType())])

    def run(batches):
        for pdf in batches:
            pdf["_raw"] = pd.Series(list(fn(pdf[prompt].tolist())), index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(run, schema).withColumn(out, F.coalesce("_raw", F.lit(NO_RESPONSE))).drop("_raw")
