"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word's vector holds how often each letter occurs; one inserted or deleted letter moves it by 1, a
replaced one by 1 up and 1 down, so near words lie within L1 distance 2. Vectors are kept in unary: bit
"letter x at least t times", two thresholds a letter, so that a box is two 64-bit masks (bits that all
of its words have, bits that any has) and a word's distance above and below a box two bit counts.
Thresholds depend on the searched length alone, so they bound the true distance from below for every
word; what passes is verified letter by letter.

Words are searched per length pair: those of length m among length m, those of length m - 1 among length
m. Each searched length is cut by the top of a k-d tree into cells of about ``CELL`` words; the top is
fitted on a bounded sample (about ``SAMPLE`` words of small hashes), which shapes the cells and no result.
Every word lives in one cell and is sent as a query to each cell that its box reaches; a cell that the
sample cannot split further is dealt by hash, and queries go to all of its parts. Within a cell a tree
with leaves of ``LEAF`` words is built in numpy, and queries stream through it in blocks: a task holds
one cell's words and one block of queries.

Words are counted natively with map-side combining (a frequent word is one row a task); forms are
followed to the last by pointer doubling over the words that have one.

Defined results: null text has no words; a null id counts as an empty one; rows that repeat count each
time; no words give an empty result; further columns are not read and may have any name. Runs of any
length are words (cells hold fewer of them, by their bytes).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import col, give_back, stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words (and bytes of words) of a cell, of a leaf; words that shape the cells; pairs of a step.
CELL, CELL_BYTES, LEAF, SAMPLE, STEP = 1 << 14, 1 << 25, 32, 1 << 16, 1 << 18
#: A-Z never occur; a-z have two thresholds, the 64 letters above share 12 places of one threshold.
_PLACE = np.full(256, 255, np.uint8)
_PLACE[97:123] = np.arange(26)
_PLACE[192:256] = 26 + np.arange(64) % 12


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run without one letter if 31 divides its hash: variants planted by rule."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """``word, n`` of the words long and frequent enough."""
    runs = docs.select(col(id_col).alias("id"), F.explode(F.regexp_extract_all(col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.where(F.length("run") >= min_chars).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    return (long.select(misspelt(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


# -- vectors ---------------------------------------------------------------------------------------

def _thresholds(m: int) -> tuple[int, int]:
    """Counts that tell words of length m apart: 1 and 2 for common lengths, about the mean beyond."""
    low = max(1, round(m / 26))
    return low, low + max(1, math.isqrt(low))


def masks(letters: np.ndarray, m: int) -> np.ndarray:
    """Unary letter counts of words (rows of a Latin-1 matrix) under the thresholds of length m."""
    place = _PLACE[letters]
    low, high = _thresholds(m)
    out = np.zeros(len(letters), np.uint64)
    for k in range(38):
        n = np.count_nonzero(place == k, axis=1)
        out |= (n >= low).astype(np.uint64) << np.uint64(k)
        if k < 26:
            out |= (n >= high).astype(np.uint64) << np.uint64(38 + k)
    return out


def matrix(words: list[str]) -> np.ndarray:
    """Words of equal length as rows of Latin-1 codes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


# -- tops of the trees: cells ------------------------------------------------------------------------

def fit_top(sample: np.ndarray, rows: float, capacity: int) -> list[tuple]:
    """Nodes of one length's top: ``(bit, zero child, one child)`` or ``(-1, first cell, parts)``."""
    nodes: list[tuple] = []
    cells = 0

    def grow(x: np.ndarray, rows: float) -> int:
        nonlocal cells
        me = len(nodes)
        nodes.append(())
        share = np.array([np.count_nonzero(x >> np.uint64(b) & np.uint64(1)) for b in range(64)]) / max(1, len(x))
        bit = int(np.argmin(np.abs(share - 0.5)))
        if rows <= capacity or len(x) < 32 or not 0.05 < share[bit] < 0.95:
            parts = max(1, math.ceil(rows / capacity))
            nodes[me] = (-1, cells, parts)
            cells += parts
            return me
        one = (x >> np.uint64(bit) & np.uint64(1)).astype(bool)
        zero_child = grow(x[~one], rows * (1 - share[bit]))
        nodes[me] = (bit, zero_child, grow(x[one], rows * share[bit]))
        return me

    grow(sample, rows)
    return nodes


def reach(top: np.ndarray, q: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, first cell, parts) of every leaf within ``up`` and ``down`` bits of each mask."""
    i, node = np.arange(len(q)), np.zeros(len(q), np.int64)
    u, d = np.full(len(q), up, np.int8), np.full(len(q), down, np.int8)
    ends = []
    while len(i):
        bit = top[node, 0]
        leaf = bit < 0
        ends.append((i[leaf], top[node[leaf], 1], top[node[leaf], 2]))
        i, node, u, d, bit = i[~leaf], node[~leaf], u[~leaf], d[~leaf], bit[~leaf]
        one = (q[i] >> bit.astype(np.uint64) & np.uint64(1)).astype(bool)
        own = np.where(one, top[node, 2], top[node, 1])
        far = np.where(one, top[node, 1], top[node, 2])
        u2, d2 = u - ~one, d - one
        go = (u2 >= 0) & (d2 >= 0)
        i, node = np.concatenate([i, i[go]]), np.concatenate([own, far[go]])
        u, d = np.concatenate([u, u2[go]]), np.concatenate([d, d2[go]])
    return tuple(np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (i, i, i)


# -- one cell: tree, search, verification --------------------------------------------------------------

class Cell:
    """The words of one cell (all of length m) and the k-d tree over them."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = np.array(words, object), n
        self.letters = matrix(words)
        self.m = self.letters.shape[1]
        mask = masks(self.letters, self.m)
        order, nodes = np.arange(len(words)), []  # nodes: all bits, any bits, first word, end, zero child, one child

        def grow(lo: int, hi: int) -> int:
            me = len(nodes)
            x = mask[order[lo:hi]]
            nodes.append([np.bitwise_and.reduce(x), np.bitwise_or.reduce(x), lo, hi, -1, -1])
            mixed = nodes[me][0] ^ nodes[me][1]
            if hi - lo <= LEAF or not mixed:
                return me
            bits = [b for b in range(64) if int(mixed) >> b & 1]
            ones = np.array([np.count_nonzero(x & np.uint64(1 << b)) for b in bits])
            k = int(np.argmin(np.abs(2 * ones - len(x))))
            one = (x & np.uint64(1 << bits[k])) != 0
            order[lo:hi] = np.concatenate([order[lo:hi][~one], order[lo:hi][one]])
            cut = hi - int(ones[k])
            nodes[me][4] = grow(lo, cut)
            nodes[me][5] = grow(cut, hi)
            return me

        grow(0, len(words))
        self.all, self.any = (np.array([x[k] for x in nodes], np.uint64) for k in (0, 1))
        self.lo, self.hi, self.zero, self.one = (np.array([x[k] for x in nodes], np.int32) for k in (2, 3, 4, 5))
        self.words, self.n, self.letters, self.mask = self.words[order], self.n[order], self.letters[order], mask[order]
        self.rank = np.argsort(np.argsort(self.words))

    def pairs(self, letters: np.ndarray):
        """(query numbers, word numbers) one edit apart, in blocks; queries of length m or m - 1."""
        q = masks(letters, self.m)
        same = letters.shape[1] == self.m
        i, node = np.arange(len(q), dtype=np.int32), np.zeros(len(q), np.int32)
        while len(i):
            x = q[i]
            near = (np.bitwise_count(self.all[node] & ~x) <= 1) & (np.bitwise_count(x & ~self.any[node]) <= int(same))
            i, node = i[near], node[near]
            leaf = self.zero[node] < 0
            yield from self._leaves(letters, q, i[leaf], node[leaf], same)
            i, node = i[~leaf], node[~leaf]
            i, node = np.concatenate([i, i]), np.concatenate([self.zero[node], self.one[node]])

    def _leaves(self, letters, q, i, node, same):
        size = self.hi[node] - self.lo[node]
        ends = np.cumsum(size)
        at = 0
        while at < len(i):  # whole leaves of one block; a leaf of equal vectors can be longer than a block
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
            for lo in range(0, int(size[at]) if to == at + 1 else 1, STEP):
                s = np.minimum(size[at:to] - lo, STEP)
                qi = np.repeat(i[at:to], s)
                wi = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s) + np.repeat(self.lo[node[at:to]] + lo, s)
                close = np.flatnonzero(np.bitwise_count(q[qi] ^ self.mask[wi]) <= 1 + int(same))
                width = max(1, STEP * 8 // self.m)
                for k in range(0, len(close), width):
                    a, b = qi[close[k:k + width]], wi[close[k:k + width]]
                    ok = one_edit(letters[a], self.letters[b])
                    yield a[ok], b[ok]
            at = to


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where b is a with one letter replaced, or (b longer by one) with one letter more."""
    if a.shape[1] == b.shape[1]:
        return np.count_nonzero(a != b, axis=1) == 1
    m = b.shape[1]
    ahead, behind = a != b[:, :-1], a != b[:, 1:]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), m)  # letters before it are equal
    last = np.where(behind.any(axis=1), m - 2 - behind[:, ::-1].argmax(axis=1), -1)  # those behind it too
    return last < first


def _best(key: np.ndarray, n: np.ndarray, rank: np.ndarray, other: np.ndarray):
    """For each key: how many rows, and n and ``other`` of the row of largest n (ties: smallest rank)."""
    order = np.lexsort((rank, -n, key))
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    return key[order][first], np.diff(first, append=len(order)), n[order][first], other[order][first]


FOUND = "word string, n_near long, best_n long, best string"


def _search(cell: Cell, words: list[str], n: np.ndarray):
    """Partial results of the queries, and of the cell's words where the queries are shorter."""
    words = np.array(words, object)
    rank = np.argsort(np.argsort(words))
    got = list(cell.pairs(matrix(words.tolist())))
    a, b = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
    if not len(a):
        return
    sides = [(words, *_best(a, cell.n[b], cell.rank[b], cell.words[b]))]
    if len(words[0]) < cell.m:
        sides.append((cell.words, *_best(b, n[a], rank[a], words[a])))
    for own, key, count, best_n, best in sides:
        yield pa.RecordBatch.from_arrays([pa.array(own[key], pa.string()), pa.array(count), pa.array(best_n), pa.array(best, pa.string())],
                                         names=["word", "n_near", "best_n", "best"])


def _blocks(words: list[str]) -> int:
    return max(1, min(1024, CELL_BYTES // (8 * len(words[0]))))


def _cells(batches):
    """Rows sorted by (m, cell, role): a cell's words (role 0), then queries of its length (1) and of
    one less (2)."""
    at, home, home_n, cell = None, [], [], None

    def built():
        made = Cell(home, np.concatenate(home_n))
        step = _blocks(home)
        for k in range(0, len(home), step):  # the words are queries themselves
            yield from _search(made, made.words[k:k + step].tolist(), made.n[k:k + step])
        return made

    for batch in batches:
        m, c, role = (batch.column(k).to_numpy() for k in range(3))
        words, n = batch.column(3).to_pylist(), batch.column(4).to_numpy()
        cuts = np.flatnonzero((np.diff(m) != 0) | (np.diff(c) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(m)], strict=True):
            if hi == lo:
                continue
            key = (int(m[lo]), int(c[lo]))
            if key != at:
                if home and cell is None:
                    yield from built()
                at, home, home_n, cell = key, [], [], None
            if role[lo] == 0:
                home += words[lo:hi]
                home_n.append(n[lo:hi])
                continue
            if not home:
                continue  # no words of that length
            if cell is None:
                cell = yield from built()
            step = _blocks(words[lo:hi])
            for k in range(lo, hi, step):
                yield from _search(cell, words[k:min(k + step, hi)], n[k:min(k + step, hi)])
    if home and cell is None:
        yield from built()
    give_back()


def _dealt(tops: dict[int, list[tuple]]):
    """Each word to its own cell (role 0) and as a query to all others within its reach."""
    trees = {m: np.array(t, np.int64) for m, t in tops.items()}
    lone = np.array([(-1, 0, 1)], np.int64)

    def run(batches):
        for batch in batches:
            words, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            size = np.array([len(w) for w in words], np.int64)
            for length in np.unique(size):
                at = np.flatnonzero(size == length)
                letters = matrix(words[at].tolist())
                out = []
                top = trees.get(int(length), lone)
                q = masks(letters, int(length))
                i, first, parts = reach(top, q, 0, 0)
                own = np.zeros(len(at), np.int64)
                own[i] = first + (np.array([hash_of(w) for w in words[at[i]]], np.int64) % parts if (parts > 1).any() else 0)
                out.append((np.arange(len(at)), own, np.full(len(at), int(length)), np.zeros(len(at), np.int64)))
                for m, role, tree, x, down in ((int(length), 1, top, q, 1), (int(length) + 1, 2, None, None, 0)):
                    if tree is None:
                        tree, x = trees.get(m, lone), masks(letters, m)
                    i, first, parts = reach(tree, x, 1, down)
                    i, cell = np.repeat(i, parts), np.repeat(first - (np.cumsum(parts) - parts), parts) + np.arange(int(parts.sum()))
                    if role == 1:
                        i, cell = i[cell != own[i]], cell[cell != own[i]]
                    out.append((i, cell, np.full(len(i), m), np.full(len(i), role)))
                i, cell, m, role = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(role.astype(np.int32)),
                                                  pa.array(words[at[i]], pa.string()), pa.array(n[at[i]])], names=["m", "cell", "role", "word", "n"])
        give_back()

    return run


def hash_of(word: str) -> int:
    import zlib
    return zlib.crc32(word.encode())


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` for the words of ``vocabulary(word, n)`` (stored; distinct words)
    that have near ones: how many, and the one of largest n (ties: smallest)."""
    spark = vocabulary.sparkSession
    sized = vocabulary.withColumn("len", F.length("word"))
    capacity = lambda m: max(1, min(CELL, CELL_BYTES // m))
    large = sized.groupBy("len").count().where((F.col("count") > CELL) | (F.col("count") * F.col("len") > CELL_BYTES))
    rows = {r["len"]: r["count"] for r in large.collect()}  # at most a row for each CELL words
    sample: dict[int, list[str]] = {m: [] for m in rows}
    if rows:
        share = min(1.0, SAMPLE / sum(rows.values()))
        chosen = sized.where(F.col("len").isin(list(rows)) & (F.col("len") < 256) & (F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(share * (1 << 40))))
        for r in chosen.select("len", "word").collect():
            sample[r["len"]].append(r["word"])
    tops = {m: fit_top(masks(matrix(x), m) if x else np.zeros(0, np.uint64), rows[m], capacity(m)) for m, x in sample.items()}
    cells = sum(first + parts for t in tops.values() for bit, first, parts in t[-1:])
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(cells, 20_000))
    dealt = vocabulary.select("word", F.col("n").cast("long").alias("n")).mapInArrow(_dealt(tops), "m int, cell int, role int, word string, n long")
    found = dealt.repartition(partitions, "m", "cell").sortWithinPartitions("m", "cell", "role").mapInArrow(_cells, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: forms followed to the last by doubling."""
    step = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = step.select(F.col("word").alias("w"), F.col("root").alias("r"))
        moved = stored(step.join(further, F.col("root") == F.col("w"), "left")
                       .select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return step
        step = moved.select("word", "root")


def group_variants(docs: DataFrame, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word. A word's form is its near word of largest
    n, if that is at least ``ratio`` times the word's own; its root the last form."""
    words = stored(word_counts(docs, id_col, text_col), "words")
    best = stored(near_words(words), "near-words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = stored(words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "variants")
    roots = last_forms(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
