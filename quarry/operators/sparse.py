"""Sparse text vectors (EMB-1) and exact retrieval over inverted lists.

A text's words (runs of letters, marks, numbers and ``_``, lower-cased) are hashed to term numbers; a
vector is ``array<struct<term:int, weight:double>>`` in the order of its terms, without zeros.
Words are found by expressions, counted and weighted by batches. Only the counts are written, beside the
texts: weights are an expression over them, which costs no disk and is computed where they are read.

``nearest_by_terms`` finds the rows of largest inner product. Blocks of corpus rows meet blocks of
questions in the task that reads them; postings are neither written nor shuffled. Within a block:

1. Each inverted list has its largest weight; a question's weight times that bounds what the term can add.
2. The k-th best product of the rows that the task has seen is a question's threshold.
3. Terms whose bounds together stay below the threshold can't bring a row in alone: their lists, the long
   ones, are not read. Rows of the others whose partial product and bound of the rest reach the
   threshold are multiplied out exactly.

A task hands on k rows a question at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import give_back, small_batches, stored

WORD = r"[\p{L}\p{M}\p{N}_]+"
VECTOR = "array<struct<term:int,weight:double>>"
#: Slack of sums that are added in another order.
SLACK = 1e-9
#: Words counted at once; questions of a block; bytes of a block of questions and of corpus rows; bytes of
#: questions that a task holds.
WORDS_AT_ONCE = 1 << 19
QUERY_BLOCK, QUERY_BLOCK_BYTES, ROW_BLOCK_BYTES = 4096, 1 << 20, 4 << 20
HELD_BYTES = 16 << 20

_BLOCK = "ids binary, size binary, terms binary, weights binary"
_FOUND = "qid bigint, vid bigint, score double"


def _numbers(words: pa.Array) -> np.ndarray:
    """The first seven hexadecimal digits of each word's MD5."""
    prints = b"".join([hashlib.md5(w).digest()[:4] for w in words.cast(pa.binary()).to_numpy(zero_copy_only=False)])
    return (np.frombuffer(prints, ">u4") >> 4).astype(np.int64)


def _lists(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of a column of lists, null as empty, and their values one after the other."""
    return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64), a.flatten()


def _as_lists(size: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)


def _pieces(size: np.ndarray, most: int, rows: int = 1 << 62) -> Iterator[tuple[int, int, int, int]]:
    """``(first row, row behind the last, first value, value behind the last)`` of pieces of lists with
    ``most`` values and ``rows`` rows at most; one longer list is a piece of its own."""
    at = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(size):
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1), i + rows)
        yield i, j, int(at[i]), int(at[j])
        i = j


def term_counts(text: Column, num_features: int) -> Column:
    """``array<bigint>`` of a text's terms in their order, each with its count in the upper 32 bits; null
    text has none."""
    def count(words: pa.Array) -> pa.Array:
        size, flat = _lists(words)
        done = [pa.array([], pa.list_(pa.int64()))]
        for i, j, a, b in _pieces(size, WORDS_AT_ONCE):
            coded = flat.slice(a, b - a).dictionary_encode()
            keys = np.repeat(np.arange(j - i) * num_features, size[i:j]) + (_numbers(coded.dictionary) % num_features)[coded.indices.to_numpy()]
            keys.sort()
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            row, term = np.divmod(keys[first], num_features)
            done.append(_as_lists(np.bincount(row, minlength=j - i), pa.array(np.diff(first, append=len(keys)) << 32 | term)))
        return pa.concat_arrays(done)

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.arrow_udf(count, "array<bigint>")(words)


def _weighted(counts: Column, idf: np.ndarray, normalise: bool) -> Column:
    def weigh(counts: pa.Array) -> pa.Array:
        size, flat = _lists(counts)
        flat = flat.to_numpy(zero_copy_only=False)
        row, term = np.repeat(np.arange(len(size)), size), flat & 0xFFFFFFFF
        weight = (flat >> 32) * idf[term]
        keep = weight != 0
        row, term, weight = row[keep], term[keep], weight[keep]
        if normalise:
            weight = weight / np.sqrt(np.bincount(row, weight * weight, minlength=len(size)))[row]
        pairs = pa.StructArray.from_arrays([pa.array(term.astype(np.int32)), pa.array(weight)], names=["term", "weight"])
        return _as_lists(np.bincount(row, minlength=len(size)), pairs)

    return F.arrow_udf(weigh, VECTOR)(counts)


def tfidf_embed(df: DataFrame, text: str = "content", num_features: int = 1 << 12, out: str = "embedding", normalise: bool = False) -> DataFrame:
    """Offline default model, fit on ``df`` itself: term counts weighted by ``ln((rows + 1) / (rows with the
    term + 1))``, as the sparse column ``out``; ``normalise`` scales it to length 1. The counts are
    written once with the rows, weights are computed from them wherever ``out`` is read; one row a term
    comes to the driver. A null or wordless text has an empty vector."""
    small_batches(df.sparkSession)
    counted = stored(df.withColumn(out, term_counts(F.col(text), num_features)), "term-counts")
    m = counted.count()
    seen = counted.select(F.explode(out).alias("term")).groupBy(F.col("term").bitwiseAND(0xFFFFFFFF).alias("term")).agg(F.count("*").alias("n"))
    idf = np.zeros(num_features)
    for r in seen.select("term", F.log((m + 1.0) / (F.col("n") + 1.0)).alias("idf")).collect():
        idf[r["term"]] = r["idf"]
    return counted.withColumn(out, _weighted(F.col(out), idf, normalise))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"])


class _Block:
    """Sparse rows one after the other: row ``i`` has the values from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.size, self.terms, self.weights = ids, size, terms, weights
        self.at = np.concatenate([[0], np.cumsum(size)])

    @staticmethod
    def read(*parts: pa.BinaryScalar) -> _Block:
        return _Block(*(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(parts, (np.int64, np.int64, np.int32, np.float64), strict=True)))


def _blocks(batch: pa.RecordBatch, most: int, rows: int = 1 << 62) -> Iterator[_Block]:
    """Rows ``(id, vector)`` as blocks of about ``most`` bytes; null and empty vectors are left out."""
    size, flat = _lists(batch.column(1))
    term, weight = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
    ids, size = batch.column(0).to_numpy()[size > 0], size[size > 0]
    for i, j, a, b in _pieces(size, most // 12, rows):
        yield _Block(ids[i:j].astype(np.int64), size[i:j], term[a:b].astype(np.int32), weight[a:b].astype(np.float64))


def _packed(most: int, rows: int = 1 << 62) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _blocks(batch, most, rows):
                yield pa.RecordBatch.from_pydict({"ids": [x.ids.tobytes()], "size": [x.size.tobytes()], "terms": [x.terms.tobytes()], "weights": [x.weights.tobytes()]})

    return run


class _Best:
    """The k rows of largest product with each question of a block so far, by (product, id). Equal rows
    never pile up: after each step only k of them stay."""

    def __init__(self, questions: _Block, k: int):
        self.k, self.qids = k, questions.ids
        self.score = np.full((len(self.qids), k), -np.inf)
        self.vid = np.full((len(self.qids), k), np.iinfo(np.int64).max)

    def add(self, questions: _Block, rows: _Block) -> None:
        known = np.unique(questions.terms)
        asked = np.searchsorted(known, questions.terms)
        place = np.minimum(np.searchsorted(known, rows.terms), len(known) - 1)
        place = np.where(known[place] == rows.terms, place, len(known))  # the last list is never asked for
        order = np.argsort(place.astype(np.min_scalar_type(len(known))), kind="stable")
        row, weight = np.repeat(np.arange(len(rows.ids)), rows.size)[order], rows.weights[order]
        length = np.bincount(place, minlength=len(known) + 1)
        end = np.cumsum(length)
        most = np.zeros(len(known) + 1)
        most[length > 0] = np.maximum.reduceat(weight, (end - length)[length > 0])
        wanted = np.zeros(len(known) + 1)  # a question's weights by list
        for q in range(len(self.qids)):
            a, b = questions.at[q], questions.at[q + 1]
            lists, qw = asked[a:b], questions.weights[a:b]
            met = length[lists] > 0
            lists, qw = lists[met], qw[met]
            bound = qw * most[lists]
            weakest = np.argsort(bound, kind="stable")
            reach = np.cumsum(bound[weakest])
            least = self.score[q, -1] * (1 - SLACK)
            weak = int(np.searchsorted(reach, least))
            if weak == len(lists):
                continue
            rest = reach[weak - 1] if weak else 0.0
            needed = weakest[weak:]
            of, part = self._read(row, weight, end, length, lists[needed], qw[needed], len(rows.ids))
            of, least = self._open(of, part, rest, least)
            if rest and rows.size[of].sum() > length[lists[weakest[:weak]]].sum():  # then the other lists are shorter than the open rows
                part += self._read(row, weight, end, length, lists[weakest[:weak]], qw[weakest[:weak]], len(rows.ids))[1]
                of, least = self._open(of, part, 0.0, least)
            if len(of):
                wanted[asked[a:b]] = questions.weights[a:b]
                self._keep(q, rows.ids[of], _products(rows, of, wanted, place))
                wanted[asked[a:b]] = 0.0

    @staticmethod
    def _read(row: np.ndarray, weight: np.ndarray, end: np.ndarray, length: np.ndarray, lists: np.ndarray, qw: np.ndarray,
              n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are in one of the lists, and what the lists add to each row's product."""
        spans = [slice(end[u] - length[u], end[u]) for u in lists]
        of, touched = np.concatenate([row[s] for s in spans]), np.zeros(n, bool)
        touched[of] = True
        return np.flatnonzero(touched), np.bincount(of, np.concatenate([weight[s] * w for s, w in zip(spans, qw, strict=True)]), minlength=n)

    def _open(self, of: np.ndarray, part: np.ndarray, rest: float, least: float) -> tuple[np.ndarray, float]:
        """Rows that can still be among the k best, and the threshold that their partial products give."""
        part = part[of]
        if len(of) >= self.k:
            least = max(least, np.partition(part, len(part) - self.k)[-self.k] * (1 - SLACK))
        return of[(part + rest) * (1 + SLACK) >= least], least

    def _keep(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.vid[q], ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score[q], self.vid[q] = score[order], ids[order]

    def found(self) -> pa.RecordBatch:
        q, i = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_pydict({"qid": self.qids[q], "vid": self.vid[q, i], "score": self.score[q, i]})


def _products(rows: _Block, of: np.ndarray, wanted: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whole products of the rows ``of``, each added up in the order of its terms."""
    size = rows.size[of]
    at = np.repeat(rows.at[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.bincount(np.repeat(np.arange(len(of)), size), rows.weights[at] * wanted[place[at]], minlength=len(of))


def _search(k: int, asked: list[tuple]) -> Callable:
    """Corpus rows with all blocks of questions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = [_Block.read(*map(pa.scalar, x)) for x in asked]
        best = [_Best(x, k) for x in questions]
        for batch in batches:
            for rows in _blocks(batch, ROW_BLOCK_BYTES):
                for x, own in zip(best, questions, strict=True):
                    x.add(own, rows)
        for x in best:
            yield x.found()
        give_back()

    return run


def _search_pairs(k: int) -> Callable:
    """Blocks of corpus rows, each with a block of questions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        last, questions = None, None
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block != last:
                    last, questions = block, _Block.read(*(c[i] for c in batch.columns[1:5]))
                if block not in best:
                    best[block] = _Best(questions, k)
                best[block].add(questions, _Block.read(*(c[i] for c in batch.columns[5:])))
        for x in best.values():
            yield x.found()
        give_back()

    return run


def nearest_by_terms(questions: DataFrame, corpus: DataFrame, k: int, qid: str = "qid", qvec: str = "qvec", vid: str = "vec_id",
                     vec: str = "embedding", held_bytes: int = HELD_BYTES) -> DataFrame:
    """``qid, rank, vid, score``: the ``k`` rows of ``corpus`` of largest inner product with each question
    (ties: smaller id), among those that share a term with it. Weights are not negative. Vectors that
    are null or empty find nothing and are not found; ids are distinct.

    Questions of up to ``held_bytes`` go to every task, which reads its rows once; more are joined with
    blocks of rows, block by block. Both give the same rows."""
    small_batches(corpus.sparkSession)
    asked = questions.where(F.col(qid).isNotNull()).select(F.col(qid).cast("bigint").alias("qid"), F.col(qvec).alias("q"))
    parts = max(1, -(-asked.select("qid").count() // QUERY_BLOCK))
    blocks = asked.repartition(parts, "qid").mapInArrow(_packed(QUERY_BLOCK_BYTES, QUERY_BLOCK), _BLOCK)
    blocks = stored(blocks.select(F.monotonically_increasing_id().alias("block"), *[F.col(c).alias(f"q_{c}") for c in blocks.columns]), "question-blocks")
    rows = corpus.where(F.col(vid).isNotNull()).select(F.col(vid).cast("bigint").alias("vid"), F.col(vec).alias("v"))
    held = blocks.agg(F.sum(sum((F.octet_length(c) for c in blocks.columns[1:]), F.lit(0).cast("bigint"))).alias("b")).first()["b"] or 0
    if held <= held_bytes:
        found = rows.mapInArrow(_search(k, [tuple(map(bytes, b)) for b in blocks.drop("block").collect()]), _FOUND)
    else:
        packed = rows.mapInArrow(_packed(ROW_BLOCK_BYTES), _BLOCK)
        found = packed.crossJoin(blocks).select(*blocks.columns, *packed.columns).mapInArrow(_search_pairs(k), _FOUND)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    found = found.withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("qid", F.col("rank").cast("int").alias("rank"), "vid", "score")
