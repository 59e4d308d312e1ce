"""Byte-level convolutional quality classifier in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters of
``WIDTH`` bytes run over each chunk (each byte is looked up in one table for each place of the filter,
which is a convolution over one-hot bytes), a rectifier follows, and each filter's largest and mean
response over the chunk make the chunk's features. The chunks' features are pooled over the
document (largest and mean), and a hidden layer combines them into one probability.

The model is trained on a bounded sample of labelled documents (``TRAIN_DOCS`` and ``TRAIN_BYTES``, the
first by a hash of the id) on the driver, on all chunks of their whole texts, in a fixed order from a fixed seed, so
that reruns agree. Scoring runs in Arrow slices, whole texts, by the same chunks.

Defined results: null text scores as the empty text (one chunk of padding); labels that are null
or have no document teach nothing; a document with contradictory labels teaches the smaller; with
labels of one kind or none the score is the share of label 1 (0.5 without labels); repeated rows are
each scored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import append_by_batch, binary_parts, col, stored

#: Labelled documents that training takes at most.
TRAIN_DOCS = 2000
#: Bytes of their texts that training takes at most.
TRAIN_BYTES = 64 << 20
FILTERS, WIDTH, HIDDEN = 16, 4, 16
CHUNK, OVERLAP = 512, 8
#: Chunks whose responses are held at once.
GROUP = 64
EPOCHS, BATCH, RATE = 6, 32, 5e-3


class Model:
    """Parameters: ``table`` (WIDTH, 256, FILTERS), ``bias``, hidden layer ``w1 b1``, output ``w2 b2``."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.table = (r.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        n = 4 * FILTERS
        self.w1 = (r.standard_normal((n, HIDDEN)) / np.sqrt(n)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = (r.standard_normal(HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.centre, self.scale = np.zeros(n, np.float32), np.ones(n, np.float32)
        self.constant: float | None = None

    def params(self):
        return [self.table, self.bias, self.w1, self.b1, self.w2, self.b2]

    def respond(self, chunk: np.ndarray) -> np.ndarray:
        """Filter responses at every place of bytes (n,) -> (n - WIDTH + 1, FILTERS)."""
        n = len(chunk) - WIDTH + 1
        out = self.table[0].take(chunk[:n], axis=0)
        for k in range(1, WIDTH):
            out += self.table[k].take(chunk[k:k + n], axis=0)
        out += self.bias
        return np.maximum(out, 0, out=out)

    def features(self, text: np.ndarray) -> np.ndarray:
        """(4 * FILTERS,) of one whole document: largest and mean over chunks of each filter's
        largest and mean response."""
        text = padded(text)
        step = CHUNK - OVERLAP
        starts = np.arange(0, max(1, len(text) - OVERLAP), step)
        top, mean = np.zeros((2, len(starts), FILTERS), self.table.dtype)
        for a in range(0, len(starts), GROUP):
            part = text[starts[a]:min(len(text), starts[min(a + GROUP, len(starts)) - 1] + CHUNK)]
            r = self.respond(part)
            for j in range(a, min(a + GROUP, len(starts))):
                x = r[starts[j] - starts[a]:starts[j] - starts[a] + CHUNK - WIDTH + 1]
                if len(x):
                    top[j], mean[j] = x.max(axis=0), x.mean(axis=0)
        return np.concatenate([top.max(axis=0), top.mean(axis=0), mean.max(axis=0), mean.mean(axis=0)])

    def head(self, f: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(f), self.constant)
        h = np.maximum((f - self.centre) / self.scale @ self.w1 + self.b1, 0)
        z = (h @ self.w2 + self.b2).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        return self.head(np.stack([self.features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]))


def padded(text: np.ndarray) -> np.ndarray:
    return text if len(text) >= WIDTH else np.concatenate([text, np.zeros(WIDTH - len(text), np.uint8)])


def train(texts: list[bytes], labels: list[int], seed: int = 3) -> Model:
    """Adam on the logistic loss, by the exact gradient of all parameters."""
    model = Model(seed)
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    docs = [padded(np.frombuffer(t, np.uint8)) for t in texts]
    r = np.random.default_rng(seed)
    m1, m2 = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()]
    # features start centred on a first look at the whole sample
    look = [model.features(d) for d in docs]
    model.centre, model.scale = np.mean(look, axis=0), np.std(look, axis=0) + 1e-2
    t = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(docs))
        for a in range(0, len(order), BATCH):
            idx = order[a:a + BATCH]
            _, grads = loss_and_gradients(model, [docs[i] for i in idx], y[idx])
            t += 1
            for q, g, a1, a2 in zip(model.params(), grads, m1, m2, strict=True):
                a1 += 0.1 * (g - a1)
                a2 += 0.001 * (g * g - a2)
                q -= RATE * (a1 / (1 - 0.9**t)) / (np.sqrt(a2 / (1 - 0.999**t)) + 1e-8)
    return model


def loss_and_gradients(model: Model, docs: list[np.ndarray], y: np.ndarray):
    """Mean logistic loss of padded texts and its gradient for ``model.params()``. Filters learn through
    all four pooled features: largest responses through their places, means through every place."""
    parts = [_forward(model, d) for d in docs]
    f = (np.stack([p[0] for p in parts]) - model.centre) / model.scale
    pre = f @ model.w1 + model.b1
    h = np.maximum(pre, 0)
    z = np.clip(h @ model.w2 + model.b2, -30, 30)
    loss = float(np.mean(np.logaddexp(0, z) - y * z))
    dz = ((1 / (1 + np.exp(-z)) - y) / len(docs)).astype(np.float32)
    dh = np.outer(dz, model.w2) * (pre > 0)
    df = (dh @ model.w1.T) / model.scale
    g_table, g_bias = np.zeros(model.table.shape, np.float64), np.zeros(FILTERS, np.float64)
    for d, doc, part in zip(df, docs, parts, strict=True):
        _filter_gradients(model, doc, part, d.reshape(4, FILTERS), g_table, g_bias)
    return loss, [g_table.astype(np.float32), g_bias.astype(np.float32), f.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()], np.float32)]


def _filter_gradients(model: Model, text: np.ndarray, part, d: np.ndarray, g_table: np.ndarray, g_bias: np.ndarray) -> None:
    """Add one document's share. ``d``: gradients of its features (largest and mean over chunks of the
    largest response, of the mean response)."""
    _, place, top, mean = part
    n, each, step = len(top), np.arange(FILTERS), CHUNK - OVERLAP
    d_top, d_mean = np.tile(d[1] / n, (n, 1)), np.tile(d[3] / n, (n, 1))
    d_top[top.argmax(axis=0), each] += d[0]
    d_mean[mean.argmax(axis=0), each] += d[2]
    for a in range(0, n, GROUP):
        last = min(a + GROUP, n)
        piece = text[a * step:min(len(text), (last - 1) * step + CHUNK)]
        r = model.respond(piece)
        g = np.zeros_like(r)
        for j in range(a, last):  # chunks overlap: places of both get a share of both
            lo = (j - a) * step
            hi = min(len(r), lo + CHUNK - WIDTH + 1)
            g[lo:hi] += d_mean[j] / (hi - lo)
        np.add.at(g, (place[a:last] - a * step, np.broadcast_to(each, (last - a, FILTERS))), d_top[a:last])
        g *= r > 0
        g_bias += g.sum(axis=0)
        for k in range(WIDTH):
            cell = piece[k:k + len(g)].astype(np.int64)[:, None] * FILTERS + each
            g_table[k] += np.bincount(cell.ravel(), weights=g.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)


def _forward(model: Model, text: np.ndarray):
    """``model.features`` of a padded text, and by chunk the place in the text and the value of each
    filter's largest response, and its mean response."""
    step, places = CHUNK - OVERLAP, CHUNK - WIDTH + 1
    starts = np.arange(0, max(1, len(text) - OVERLAP), step)
    place = np.zeros((len(starts), FILTERS), np.int64)
    top, mean = np.zeros((2, len(starts), FILTERS), model.table.dtype)
    for a in range(0, len(starts), GROUP):
        r = model.respond(text[starts[a]:min(len(text), starts[min(a + GROUP, len(starts)) - 1] + CHUNK)])
        for j in range(a, min(a + GROUP, len(starts))):
            x = r[starts[j] - starts[a]:starts[j] - starts[a] + places]
            best = x.argmax(axis=0)
            place[j], top[j], mean[j] = starts[j] + best, x[best, np.arange(FILTERS)], x.mean(axis=0)
    return np.concatenate([top.max(axis=0), top.mean(axis=0), mean.max(axis=0), mean.mean(axis=0)]), place, top, mean


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        held_out=None) -> Model:
    """Train on at most ``TRAIN_DOCS`` labelled documents of at most ``TRAIN_BYTES`` together: ids that
    have a label and a document (without those for which ``held_out(id)`` holds), in the order of
    their hash; whole texts, one for each id (of several the one of the smallest hash)."""
    ids = labels.where(col(label_col).isNotNull() & col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.min(col(label_col)).alias("y"))
    if held_out is not None:
        ids = ids.where(~held_out(F.col("id")))
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("binary"), F.lit(b"")).alias("t"))
    chosen = ids.join(rows.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    one = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    one = stored(one.withColumn("bytes", F.octet_length("t")), "training")
    total, take = 0, []
    for r in one.select("id", "bytes").orderBy(F.xxhash64("id"), "id").collect():  # TRAIN_DOCS rows at most
        total += r["bytes"]
        if total > TRAIN_BYTES:
            break
        take.append(r["id"])
    found = sorted(one.where(F.col("id").isin(take)).collect(), key=lambda r: r["id"])
    return train([bytes(r["t"]) for r in found], [int(r["y"]) for r in found])


def add_score(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``name``: the probability of label 1, from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array):
        return [pa.array(shared.value.score(*binary_parts(texts)), pa.float64())]

    return append_by_batch(docs, text_col, [T.StructField(name, T.DoubleType())], run)
