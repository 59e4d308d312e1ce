"""Nearest neighbours by a block matrix join with quantised products.

Vectors are packed into blocks: queries into blocks of at most ``QUERY_BLOCK``, candidates into
blocks of about ``CAND_BLOCK``. Each candidate block meets each query block once (one row for a
block, joined on the query block's number). In a tile both sides are int8 codes with one scale for
each vector; the product of the codes is exact in floating point, and gives the distance between the
quantised vectors. The true distance differs from it by at most the two vectors' own quantisation
errors (their norms are known), so candidates whose lower bound is above the k-th smallest upper
bound of the tile cannot be among the k nearest; the others are recomputed from the original vectors
in double precision. Tiles' short sorted lists are merged by heaps, so nothing is approximate.

Defined results: vectors that are null or zero or hold null or non-finite components take no part,
nor do rows without an id; vectors are compared with vectors of their own length only; a row's own
id is never its neighbour; repeated equal rows count once; a query id with several vectors is
searched by each of them and its lists are merged (a candidate counts with its smallest distance);
ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import col, stored

#: Vectors of one block. A tile's arrays (QUERY_BLOCK x CAND_BLOCK doubles) take 32 MB.
QUERY_BLOCK = 2048
CAND_BLOCK = 2048

_FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("salt", T.IntegerType()),
                       T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
_BLOCK = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("block", T.IntegerType()),
                       T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v as array<double>, dim) of the rows that take part, equal rows once."""
    v = col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return (vectors.select(col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
            .where(fine).distinct().withColumn("dim", F.size("v")))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, dim) packed into blocks of about ``size`` vectors: (dim, block, ids, vectors)."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    dealt = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks").cast("long")).cast("int"))

    def pack(key, t):
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)[order]
        ids = t.column("id").to_numpy()[order]
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                         "ids": pa.array([ids.astype("<i8").tobytes()]), "vectors": pa.array([v.astype("<f8").tobytes()])})

    return dealt.select("dim", "block", "id", "v").groupBy("dim", "block").applyInArrow(pack, _BLOCK)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, norm of the quantised vector, norm of the error) of each row."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # of denormal numbers: all error
    codes = np.rint(v / scale[:, None])
    coded = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((coded * coded).sum(axis=1)), np.sqrt(((v - coded) ** 2).sum(axis=1))


def tile(q_ids, q, c_ids, c, k: int) -> list[tuple[int, list[int], list[float]]]:
    """For each query vector its k nearest of the tile (all that can be among the overall k)."""
    qc, qs, qn, qe = quantise(q)
    cc, cs, cn, ce = quantise(c)
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay exact
    product = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    near = np.sqrt(np.maximum(qn[:, None] ** 2 + cn[None, :] ** 2 - 2 * product, 0.0))
    # rounding of the three terms, besides the quantisation errors
    slack = qe[:, None] + ce[None, :] + 1e-7 * (qn[:, None] + cn[None, :])
    own = q_ids[:, None] == c_ids[None, :]
    upper = np.where(own, np.inf, near + slack)
    lower = np.where(own, np.inf, near - slack)
    kth = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(q), np.inf)
    if len(np.unique(c_ids)) < len(c_ids):  # an id twice must not count twice towards the k
        kth[:] = np.inf
    out = []
    for i in range(len(q)):
        left = np.flatnonzero(~(lower[i] > kth[i]) & ~own[i])  # not a number: kept
        d = np.sqrt(((c[left] - q[i]) ** 2).sum(axis=1))
        best = np.lexsort((c_ids[left], d))
        ids, scores, seen = [], [], set()
        for j in best:
            if (x := int(c_ids[left[j]])) not in seen:
                seen.add(x)
                ids.append(x)
                scores.append(float(d[j]))
                if len(ids) == k:
                    break
        if ids:
            out.append((int(q_ids[i]), ids, scores))
    return out


def merge(lists, k: int) -> tuple[list[int], list[float]]:
    """The k nearest of several (ids, scores) lists, each sorted by (score, id)."""
    ids, scores, seen = [], [], set()
    for s, i in heapq.merge(*[list(zip(s, i, strict=True)) for i, s in lists]):
        if i not in seen:
            seen.add(i)
            ids.append(i)
            scores.append(s)
            if len(ids) == k:
                break
    return ids, scores


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    def run(key, t):
        ids, scores = merge(zip(t.column("ids").to_pylist(), t.column("scores").to_pylist(), strict=True), k)
        return pa.table({"query_id": pa.array([key[0].as_py()], pa.int64()), "salt": pa.array([0], pa.int32()),
                         "ids": pa.array([ids], pa.list_(pa.int64())), "scores": pa.array([scores], pa.list_(pa.float64()))})
    return found.groupBy(*keys).applyInArrow(run, _FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows (Euclidean distance) of each row for
    which ``is_query`` (a function of the id column) holds."""
    rows = stored(valid(vectors, id_col, vec_col), "vectors")
    q = blocks(rows.where(is_query(F.col("id"))), QUERY_BLOCK)
    c = blocks(rows, CAND_BLOCK)
    q = stored(q, "query-blocks").select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    c = stored(c, "blocks")
    numbers = q.select("dim", "q_block")
    n = max(1, c.count())
    tiles = (c.join(numbers, "dim").repartition(n, "block", "q_block").join(q, ["dim", "q_block"])
             .select("dim", "q_block", "q_ids", "q_vectors", "block", "ids", "vectors"))

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                dim = b.column(0)[at].as_py()
                qi, ci = (np.frombuffer(b.column(x)[at].as_buffer(), "<i8") for x in (2, 5))
                qv, cv = (np.frombuffer(b.column(x)[at].as_buffer(), "<f8").reshape(-1, dim) for x in (3, 6))
                found = tile(qi, qv, ci, cv, k)
                salt = b.column(4)[at].as_py() // 64
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([salt] * len(found), pa.int32()),
                                                  pa.array([f[1] for f in found], pa.list_(pa.int64())),
                                                  pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=_FOUND.names)

    found = tiles.mapInArrow(run, _FOUND)
    # lists of 64 blocks meet first, then one list of each such group
    best = _merged(_merged(found, ["query_id", "salt"], k), ["query_id"], k)
    z = best.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("pos", "x"))
    return z.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
