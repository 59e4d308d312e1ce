"""Exact self-join of documents on the Jaccard similarity of their word shingles.

Two documents are linked if the similarity of their shingle sets reaches a threshold; the result is
each document's connected component under these links. Equal sets are one class from the start, and
all further work is on classes, so copies never meet.

1. *Order.* A set's shingles (64-bit hashes) are ordered: frequent ones last, then by hash. Any two
   linked sets share a shingle within their prefixes, for any common order. Frequent shingles (those
   that more than ``FREQUENT`` classes hold) are counted over all documents: tasks send their distinct
   shingles as packed arrays to hash buckets, which add up. The most frequent ``MAX_FREQUENT`` of
   them are broadcast (8 bytes each); the order changes the work, never the result.
2. *Index.* Prefix entries (shingle, class, size, position) go to hash buckets. Lists of one entry are
   dropped there.
3. *Pivots.* Each list has a pivot, and each class is first paired with the pivot of most of its
   lists only: as many pairs as classes. They are verified on the full sets, and linked classes are
   merged into components; this is repeated for the lists that still hold several components, with
   those classes as pivots whose prefix is shared most.
4. *Skipping.* Only pairs of different components are left then. Lists are sorted by size; for each
   entry the block of partners that sizes still allow is found by search, those that positions rule out
   are skipped.
5. *Answers from similar sets.* A set's overlap with a partner is derived from its pivot's overlap with
   that partner, corrected by the few shingles in which the set and its pivot differ; first by bounds,
   exactly where they don't decide.

Index entries carry 64 bits of a class and 32 bits of a shingle: what collides adds candidates, which
are verified on full sets of classes told apart by 128 bits.

Defined results: null texts and texts without words have an empty set, are linked with nothing, and
get their own id as component; texts of 1 to ``width - 1`` words have one shingle, the whole
sequence; repeated rows and repeated ids are all returned, a component being the smallest id in it;
rows with a null id are returned with a null id, their set counts in the component of equal or linked
sets (component null if no member has an id); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import (arrow_slices, binary_parts, bucket_of, col, components, fresh, give_back, map_batches, near, pack_sorted, planes, small_batches,
                               stored, unpack_sorted, unplanes)
from quarry.llm.hashing import PLAIN, counts_by_text, mix, text_windows, windows

#: A shingle in more rows than this is ordered behind the others, if it is among the MAX_FREQUENT.
FREQUENT = 16
MAX_FREQUENT = 1 << 20
#: Shingles of one hash bucket, about; sets the number of buckets.
BUCKET = 1 << 18
#: Hashes that a task holds before it sends them to their buckets.
GROUP = 500_000
#: Bits of a parity sketch.
SKETCH = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    s, e, t = PLAIN.spans(data, offsets)
    words = PLAIN.hashes(data, s, e)
    n = counts_by_text(t, len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    at, h = text_windows(words, t, width)
    cut = np.searchsorted(at, first)
    out = []
    for i in range(len(n)):
        if n[i] >= width:
            out.append(np.unique(h[cut[i]:cut[i + 1]]))
        elif n[i]:
            out.append(windows(words[first[i]:first[i + 1]], int(n[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def need(n, m, num: int, den: int):
    """Smallest overlap that links sets of sizes n and m: den * x >= num * (n + m - x)."""
    return -(-num * (n + m) // (den + num))


def prefix_length(n: int, num: int, den: int) -> int:
    """How many first shingles of a set of size n must meet those of any linked set."""
    return n - -(-num * n // den) + 1


_SIG = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()),
                     T.StructField("cls", T.BinaryType()), T.StructField("c", T.LongType()), T.StructField("sketch", T.BinaryType())])
_PACK = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("packed", T.BinaryType())])


def parity_sketch(s: np.ndarray) -> bytes:
    """``SKETCH`` bits, each the parity of the shingles that fall on it: bits in which two sets' sketches
    differ never outnumber the shingles in which the sets do."""
    return np.packbits(np.bincount((mix(s) >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).tobytes()


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*binary_parts(b.column(1)), width)
        cls = [class_of(s) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()),
                                           pa.array([None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in cls], pa.int64()),
                                           pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())],
                                          names=_SIG.names)
    return map_batches(docs, _SIG, run, "text")


def _new_sets(batches: Iterator[pa.RecordBatch], width: int, limit: int, used):
    """Groups of (class, set) of documents; a class comes once in a group, which ends when ``used``
    of its sets add up to ``limit``."""
    group: dict[bytes, np.ndarray] = {}
    size = 0
    for piece in arrow_slices(batches, 1):
        for s in shingle_sets(*binary_parts(piece.column(1)), width):
            if len(s) and (c := class_of(s)) not in group:
                group[c] = used(s)
                size += len(group[c]) if isinstance(group[c], np.ndarray) else len(group[c][0])
        if size > limit:
            yield group
            group, size = {}, 0
            give_back()
    if group:
        yield group
    give_back()


def _by_bucket(bucket: np.ndarray, low: np.ndarray):
    """(order, starts, ends) that group entries by bucket, each sorted by ``low``."""
    o = np.lexsort((low, bucket))
    b = bucket[o]
    cut = np.flatnonzero(np.diff(b, prepend=-1))
    return o, b[cut], list(zip(cut.tolist(), [*cut[1:].tolist(), len(b)], strict=True))


def _frequent(docs: DataFrame, width: int, buckets: int) -> np.ndarray:
    """Keys (bucket, 32 bits) of frequent shingles, the most frequent ``MAX_FREQUENT`` at most, sorted."""
    def emit(batches: Iterator[pa.RecordBatch]):
        for group in _new_sets(batches, width, GROUP, lambda s: s):
            bucket, low = bucket_of(np.concatenate(list(group.values())), buckets)
            key, n = np.unique(bucket.astype(np.uint64) << np.uint64(32) | low, return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            bucket, low = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            o, names, ends = _by_bucket(bucket, low)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([pack_sorted(low[o[x:y]]) + n[o[x:y]].tobytes() for x, y in ends],
                                                                                   pa.binary())], names=_PACK.names)

    def add(t: pa.Table) -> pa.Table:
        raw = [x.as_buffer() for x in t.column("packed")]
        low = np.concatenate([unpack_sorted(x, x.size // 5) for x in raw])
        n = np.concatenate([np.frombuffer(x, np.uint8, x.size // 5, x.size // 5 * 4) for x in raw])
        u, at = np.unique(low, return_inverse=True)
        n = np.bincount(at, weights=n).astype(np.int64)
        hot = n > FREQUENT
        give_back()
        key = np.int64(t.column("bucket")[0].as_py() << 32) | u[hot].astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "n": pa.array(n[hot], pa.int64())})

    hot = docs.mapInArrow(emit, _PACK).groupBy("bucket").applyInArrow(add, "key long, n long")
    rows = hot.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).toArrow()
    return np.sort(rows.column("key").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64))


def ordered(s: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """A sorted set with its frequent shingles moved behind the others."""
    if not len(frequent) or not len(s):
        return s
    bucket, low = bucket_of(s, buckets)
    key = bucket << np.int64(32) | low.astype(np.int64)
    hot = frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
    return np.concatenate([s[~hot], s[hot]])


_LIST = T.StructType([T.StructField("list", T.LongType()), T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType()),
                      T.StructField("pos", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("pivot", T.LongType())])
#: Positions from here on count as this one, which only weakens the skipping.
LAST_POS = (1 << 16) - 1


def _index(docs: DataFrame, width: int, frequent, num: int, den: int, buckets: int) -> DataFrame:
    """Lists of two classes or more: (list, class, size, position, length of the list, pivot)."""
    def emit(batches: Iterator[pa.RecordBatch]):
        hot = frequent.value
        for group in _new_sets(batches, width, GROUP, lambda s: (ordered(s, hot, buckets)[:prefix_length(len(s), num, den)].copy(), len(s))):
            part = [p for p, _ in group.values()]
            size = np.array([len(p) for p in part])
            n = np.repeat(np.array([k for _, k in group.values()], np.uint32), size)
            c = np.repeat(np.frombuffer(b"".join(x[:8] for x in group), np.uint64), size)
            pos = np.minimum(np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size), LAST_POS).astype(np.uint16)
            bucket, low = bucket_of(np.concatenate(part), buckets)
            o, names, ends = _by_bucket(bucket, low)
            low, n, pos, c = low[o], n[o], pos[o], c[o]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(
                [pack_sorted(low[x:y]) + planes(n[x:y]) + planes(pos[x:y]) + c[x:y].tobytes() for x, y in ends], pa.binary())], names=_PACK.names)

    def lists(t: pa.Table) -> pa.Table:
        parts: tuple[list, ...] = ([], [], [], [])
        for x in t.column("packed"):
            raw = x.as_buffer()
            k = raw.size // 18
            parts[0].append(unpack_sorted(raw, k))
            parts[1].append(unplanes(raw, np.uint32, k, 4 * k))
            parts[2].append(unplanes(raw, np.uint16, k, 8 * k))
            parts[3].append(np.frombuffer(raw, np.uint64, k, 10 * k))
        h, n, pos, c = (np.concatenate(p) for p in parts)
        o = np.lexsort((n, c, h))
        h, n, pos, c = h[o], n[o], pos[o], c[o]
        new = np.ones(len(h), bool)  # the same class from another task comes again
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
        h, n, pos, c = h[new], n[new], pos[new], c[new]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff([*cut, len(h)])
        pivot = c[np.repeat(cut, size)]
        size = np.repeat(size, size).astype(np.int32)
        more = size > 1
        name = np.int64(t.column("bucket")[0].as_py() << 32) | h[more].astype(np.int64)
        give_back()
        return pa.table({"list": pa.array(name, pa.int64()), "c": pa.array(c[more].view(np.int64)), "n": pa.array(n[more].astype(np.int32)),
                         "pos": pa.array(pos[more].astype(np.int32)), "len": pa.array(size[more]), "pivot": pa.array(pivot[more].view(np.int64))})

    return docs.mapInArrow(emit, _PACK).groupBy("bucket").applyInArrow(lists, _LIST)


_SETS = T.StructType([T.StructField("c", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("items", T.BinaryType())])


def _sets(docs: DataFrame, sig: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(c, class, packed sorted set) of the classes with the given 64 bits, from one document of each."""
    chosen = stored(sig.where("cls is not null").join(near(classes), "c", "left_semi").groupBy("cls").agg(F.min(F.struct("id", "h")).alias("r"))
                    .select("cls", F.col("r.id").alias("rid"), F.col("r.h").alias("rh")), "chosen")
    texts = docs.join(near(chosen), docs.id.eqNullSafe(F.col("rid")) & (docs.h == F.col("rh"))).select("cls", "text")

    def run(batches):
        seen: set[bytes] = set()  # rows that repeat meet in one task
        for b in arrow_slices(batches, 1):
            sets = shingle_sets(*binary_parts(b.column(1)), width)
            rows = [(x, s) for x, s in zip(b.column(0).to_pylist(), sets, strict=True) if not (x in seen or seen.add(x))]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(x[:8] for x, _ in rows), np.int64), pa.int64()),
                                              pa.array([x for x, _ in rows], pa.binary()), pa.array([s.tobytes() for _, s in rows], pa.binary())],
                                             names=_SETS.names)
        give_back()

    return texts.mapInArrow(run, _SETS)


def _with_sets(pairs: DataFrame, sets: DataFrame, left: str, right: str) -> DataFrame:
    """Stored ``pairs`` with ``x``, ``x_cls`` (the set of the class ``left``) and ``y``, ``y_cls``. Only
    sets that some pair names are moved."""
    x = sets.select(F.col("c").alias(left), F.col("cls").alias("x_cls"), F.col("items").alias("x")).join(near(pairs), left)
    y = (sets.select(F.col("c").alias(right), F.col("cls").alias("y_cls"), F.col("items").alias("y"))
         .join(near(pairs.select(right).distinct()), right, "left_semi"))
    return x.join(y, right).where("x_cls <> y_cls")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets; the smaller is looked up in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


_STAR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("a_cls", T.BinaryType()),
                      T.StructField("b_cls", T.BinaryType()), T.StructField("linked", T.BooleanType()),
                      T.StructField("lost", T.BinaryType()), T.StructField("added", T.BinaryType())])


def _stars(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Verified pairs (a, its pivot b): linked or not, and for linked ones what a lacks of b and adds to it."""
    both = _with_sets(pairs, sets, "a", "b").select("a", "b", "x_cls", "y_cls", "x", "y")

    def run(batches):
        for b in arrow_slices(batches, 4, 8 << 20):
            linked, lost, added = [], [], []
            for x, y in zip(b.column(4), b.column(5), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                ok = overlap(x, y) >= need(len(x), len(y), num, den)
                linked.append(ok)
                lost.append(np.setdiff1d(y, x, assume_unique=True).tobytes() if ok else None)
                added.append(np.setdiff1d(x, y, assume_unique=True).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(linked, pa.bool_()), pa.array(lost, pa.binary()),
                                              pa.array(added, pa.binary())], names=_STAR.names)
        give_back()

    return both.mapInArrow(run, _STAR)


def _mixed(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries of lists that hold several components, with their component. ``comp(c, comp)`` has
    the classes of components of two and more; any other class is its own."""
    rows = lists.join(near(comp), "c", "left").withColumn("comp", F.coalesce("comp", "c"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("list")
        name, comp = t.column("list").to_numpy(), t.column("comp").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff([*cut, len(name)])
        mixed = np.minimum.reduceat(comp, cut) != np.maximum.reduceat(comp, cut)
        give_back()
        return t.filter(pa.array(np.repeat(mixed, size)))

    cols = ["list", "c", "n", "pos", "len", "comp"]
    schema = T.StructType([f for f in _LIST.fields if f.name != "pivot"] + [T.StructField("comp", T.LongType())])
    return rows.select(*cols).groupBy(F.shiftright("list", 32).alias("bucket")).applyInArrow(run, schema)


#: Share of its prefix that a class must share with a pivot (or that must be in lists at all) to be
#: paired with it. Pairs that this leaves out are met in the open pairs.
STRONG = 0.3


def _strong(n, size, num: int, den: int):
    return n >= STRONG * (size * (1 - num / den) + 1)


def _pivot_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Classes, with the pivot of another component that most of their lists have. A list's pivot is
    the class whose prefix meets most entries for each of its places; classes with few entries
    (they share a passage, not the text) are left out."""
    weight = stored(rows.groupBy("c").agg((F.sum("len") / F.first("n")).alias("weight"), F.count("*").alias("m"), F.first("n").alias("size"))
                    .where(_strong(F.col("m"), F.col("size"), num, den)).select("c", "weight"), "weights")
    rows = stored(rows.join(near(weight), "c"), "strong")
    top = (rows.groupBy("list").agg(F.max(F.struct("weight", "c", "comp")).alias("t"))
           .select("list", F.col("t.c").alias("pivot"), F.col("t.comp").alias("p_comp")))
    return _nearest_pivot(rows.join(top, "list").where("comp <> p_comp"), num, den)


def _nearest_pivot(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pivots that the lists of a class have, the one that most of them have: one pair for
    each class at most."""
    n = rows.groupBy("c", "pivot").agg(F.count("*").alias("k"), F.first("n").alias("size"))
    best = n.groupBy(F.col("c").alias("a")).agg(F.max(F.struct("k", "pivot", "size")).alias("t"))
    return best.where(_strong(F.col("t.k"), F.col("t.size"), num, den)).select("a", F.col("t.pivot").alias("b"))


_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("an", T.LongType()), T.StructField("bn", T.LongType()),
                      T.StructField("k", T.LongType()), T.StructField("rest", T.LongType())])


def _open_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes of different components that can be linked. The lists of one bucket are
    walked together. The first common shingle of linked sets leaves enough behind it in both, so a long
    list (more than ``FREQUENT`` entries) gives only the pairs for which that holds; a short one gives
    what sizes and positions allow with all before it in common. Then the common prefix shingles
    of a pair (``k``) are added up: the overlap is at most k, the long lists that both are in, and what
    stands behind the prefix that ends first, or behind the last common entry. Pairs whose sketches
    (``sketch``; null: unknown) differ in more bits than linked sets can differ in shingles are left out
    where they are found."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("list", "ascending"), ("n", "ascending"), ("c", "ascending")])
        sketch = t.column("sketch").to_pylist()
        known = np.array([x is not None for x in sketch], bool)
        sketch = np.frombuffer(b"".join(x or bytes(SKETCH // 8) for x in sketch), np.uint64).reshape(len(sketch), SKETCH // 64)
        name, c, comp = (t.column(k).to_numpy() for k in ("list", "c", "comp"))
        n, pos = t.column("n").to_numpy().astype(np.int64), t.column("pos").to_numpy().astype(np.int64)
        before = np.where(t.column("len").to_numpy() > FREQUENT, 0, pos)  # what can be common before
        ends = np.flatnonzero(np.append(name[1:] != name[:-1], True)) + 1
        ends = ends[np.searchsorted(ends, np.arange(len(name)), side="right")]
        who, at = np.unique(np.stack([c, n], axis=1), axis=0, return_inverse=True)
        at = at.reshape(-1)
        total = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # pair, k, rest
        held, size = [total], 0

        def merged():
            key, k, rest = (np.concatenate(x) for x in zip(*held, strict=True))
            o = np.argsort(key, kind="stable")
            key, k, rest = key[o], k[o], rest[o]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            return (key[cut], np.add.reduceat(k, cut), np.minimum.reduceat(rest, cut)) if len(key) else total

        for i in range(len(name) - 1):
            # partners are not smaller; the block ends where the size rules them out
            last = int(ends[i])
            j = i + 1 + int(np.searchsorted(n[i + 1:last], n[i] * den // num, side="right"))
            if j > i + 1:
                rest = np.minimum(n[i] - pos[i] - 1, n[i + 1:j] - pos[i + 1:j] - 1)
                least = need(n[i], n[i + 1:j], num, den)
                x = np.flatnonzero((comp[i + 1:j] != comp[i]) & (1 + before[i] + rest >= least))
                if len(x) and known[i]:
                    differ = np.bitwise_count(sketch[i] ^ sketch[i + 1 + x]).sum(axis=1, dtype=np.int64)
                    x = x[(differ <= n[i] + n[i + 1 + x] - 2 * least[x]) | ~known[i + 1 + x]]
                if len(x):
                    held.append((at[i] * len(who) + at[i + 1 + x], np.ones(len(x), np.int64), rest[x]))
                    size += len(x)
                    if size > 1_000_000:
                        held, size = [merged()], 0
        key, k, rest = merged()
        a, b = who[key // max(1, len(who))], who[key % max(1, len(who))]
        give_back()
        cols = (a[:, 0], b[:, 0], a[:, 1], b[:, 1], k, rest)
        return pa.table({f.name: pa.array(x, pa.int64()) for f, x in zip(_PAIR.fields, cols, strict=True)})

    found = rows.groupBy(F.shiftright("list", 32).alias("bucket")).applyInArrow(run, _PAIR)
    pairs = found.groupBy("a", "b", "an", "bn").agg(F.sum("k").alias("k"), F.min("rest").alias("rest"))
    long_ = near(stored(rows.where(F.col("len") > FREQUENT).groupBy("c").agg(F.count("*").alias("m")), "long-lists"))
    pairs = (pairs.join(long_.select(F.col("c").alias("a"), F.col("m").alias("am")), "a", "left")
             .join(long_.select(F.col("c").alias("b"), F.col("m").alias("bm")), "b", "left"))
    least = F.ceil(F.lit(num) * (F.col("an") + F.col("bn")) / F.lit(num + den))

    def behind(n):  # shingles behind the prefix
        return n - (n - F.ceil(F.lit(num) * n / F.lit(den)) + 1)

    # one more: two shingles of a class may share their 32 bits in a bucket
    most = (F.col("k") + 1 + F.least(F.coalesce("am", F.lit(0)), F.coalesce("bm", F.lit(0)))
            + F.least("rest", F.greatest(behind(F.col("an")), behind(F.col("bn")))))
    return pairs.where(most >= least).select("a", "b")


_LINK = T.StructType([T.StructField("a_cls", T.BinaryType()), T.StructField("b_cls", T.BinaryType())])


def _derived(pairs: DataFrame, ids: DataFrame, stars: DataFrame, sets_of, num: int, den: int) -> DataFrame:
    """Linked ones of the open pairs (a, b). The overlap of b with a's pivot p is computed once for
    the rows of (p, b), and a's is derived from it: minus what a lacks of p in b, plus what it adds."""
    star = near(stored(stars.where("linked").groupBy("a_cls").agg(F.min_by(F.struct("b", "b_cls", "lost", "added"), F.struct(
        F.octet_length("lost") + F.octet_length("added"), "b_cls")).alias("s")).select("a_cls", F.col("s.b").alias("p"), "s.b_cls", "s.lost", "s.added"), "pivots"))
    own = near(ids.select("cls", F.col("c").alias("a")))
    rows = pairs.join(own, "a").join(star, F.col("cls") == F.col("a_cls"), "left").select(
        F.col("cls").alias("a_cls"), "b", F.coalesce("p", "a").alias("p"), F.coalesce("b_cls", "cls").alias("p_cls"),
        F.coalesce("lost", F.lit(b"")).alias("lost"), F.coalesce("added", F.lit(b"")).alias("added"))
    # a class without a pivot is its own
    rows = stored(rows, "derivations")
    rows = _with_sets(rows, sets_of(rows.select(F.col("p").alias("c")).union(rows.select("b"))), "p", "b").where("x_cls = p_cls")
    rows = rows.repartition("y_cls", F.pmod(F.xxhash64("x_cls"), F.lit(64))).sortWithinPartitions("y_cls", "x_cls")
    rows = rows.select("a_cls", "y_cls", "x_cls", "lost", "added", "x", "y")

    def run(batches):
        key, base, y = None, 0, None
        for t in arrow_slices(batches, 5, 8 << 20):
            out = []
            for a, b, p, lost, added, x, other in zip(*(t.column(i) for i in range(7)), strict=True):
                a, b, p = a.as_py(), b.as_py(), p.as_py()
                if (p, b) != key:
                    first = np.frombuffer(x.as_buffer().to_pybytes(), np.uint64)
                    y = np.frombuffer(other.as_buffer().to_pybytes(), np.uint64)
                    key, base = (p, b), overlap(first, y)
                minus, plus = (np.frombuffer(v.as_buffer(), np.uint64) for v in (lost, added))
                least = need(len(first) - len(minus) + len(plus), len(y), num, den)
                if base + len(plus) < least:  # bounds decide without a look at the sets
                    continue
                if base - len(minus) >= least or base - overlap(minus, y) + overlap(plus, y) >= least:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=_LINK.names)
        give_back()

    return rows.mapInArrow(run, _LINK)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; a link is ``den * |both| >= num * |either|``."""
    out = _labelled(docs, id_col, text_col, width, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays: that of the smallest
    id (null before others; then the smallest text hash), once. Rows with an empty set all stay."""
    out = _labelled(docs, id_col, text_col, width, num, den)
    key, h, rid, rh = (fresh(x, docs.columns) for x in ("__id", "__h", "__rid", "__rh"))
    rows = docs.withColumn(key, col(id_col).cast("long")).withColumn(h, F.xxhash64(col(text_col).cast("binary")))
    stay = out.where("`group` is not null").groupBy("group").agg(F.min(F.struct("id", "h")).alias("r")).select("group", "r")
    each = out.where("`group` is not null").groupBy("group", "id", "h").agg(F.count("*").alias("n")).join(stay, "group")
    gone = stored(each.where(~(F.struct("id", "h").eqNullSafe(F.col("r")))).select(F.col("id").alias(rid), F.col("h").alias(rh)), "gone")
    again = stored(each.where(F.struct("id", "h").eqNullSafe(F.col("r")) & (F.col("n") > 1)).select(F.col("id").alias(rid), F.col("h").alias(rh)), "again")
    same = F.col(key).eqNullSafe(F.col(rid)) & (F.col(h) == F.col(rh))
    kept = rows.join(near(gone), same, "left_anti")
    if again.limit(1).count():  # rows that repeat, in id and text
        twice = kept.join(near(again), same, "left_semi").dropDuplicates([key, h])
        kept = kept.join(near(again), same, "left_anti").unionByName(twice)
    return kept.select(*[col(c) for c in docs.columns])


#: Rounds of further pivots before the remaining pairs are taken one by one.
PIVOT_ROUNDS = 1


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("binary").alias("text"))
    src = src.withColumn("h", F.xxhash64("text"))
    sig = stored(_signatures(src, width), "signatures")
    total = sig.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(64, total // BUCKET)
    frequent = spark.sparkContext.broadcast(_frequent(src, width, buckets))
    lists = stored(_index(src, width, frequent, num, den, buckets), "lists")

    def sets_of(classes: DataFrame) -> DataFrame:
        return stored(_sets(src, sig, stored(classes.distinct(), "involved"), width), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        return stored(_stars(pairs, sets_of(pairs.select(F.col("a").alias("c")).union(pairs.select("b"))), num, den), "stars")

    def merged_classes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components of classes, and the same by 64 bits of the class and of its component."""
        comp = stored(components(links.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))), "components")
        ids = near(stored(links.select(F.col("a").alias("c"), F.col("a_cls").alias("node")).union(links.select("b", "b_cls")).distinct(), "ids"))
        short = comp.join(ids, "node").join(ids.select(F.col("node").alias("component"), F.col("c").alias("comp")), "component")
        return comp, stored(short.select("c", "comp"), "components")

    stars = verified(_nearest_pivot(lists.where("c <> pivot"), num, den))
    comp, short = merged_classes(stars.where("linked"))
    rows = stored(_mixed(lists, short), "open-lists")
    for _ in range(PIVOT_ROUNDS):
        pairs = _pivot_pairs(rows, num, den).join(near(stars.select("a", "b")), ["a", "b"], "left_anti")
        new = verified(pairs)
        stars = stars.unionByName(new)
        if not new.where("linked").limit(1).count():
            break
        comp, short = merged_classes(stars.where("linked"))
        rows = stored(_mixed(rows.drop("comp"), short), "open-lists")
    tried = near(stored(stars.select("a", "b").union(stars.select("b", "a")), "tried"))
    entries = stored(rows.select("c").distinct(), "open-entries")
    sketches = sig.where("cls is not null").join(near(entries), "c", "left_semi").groupBy("c").agg(F.min("sketch").alias("x"), F.max("sketch").alias("y"))
    # classes of equal 64 bits can't be told apart here: no sketch
    sketches = stored(sketches.select("c", F.when(F.col("x") == F.col("y"), F.col("x")).alias("sketch")), "sketches")
    pairs = stored(_open_pairs(rows.join(near(sketches), "c"), num, den).join(tried, ["a", "b"], "left_anti"), "open-pairs")
    ids = sig.where("cls is not null").join(near(stored(pairs.select(F.col("a").alias("c")).distinct(), "open-classes")), "c", "left_semi")
    more = stored(_derived(pairs, stored(ids.select("c", "cls").distinct(), "ids"), stars, sets_of, num, den), "links")
    if more.limit(1).count():
        comp = stored(components(stars.where("linked").select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).union(more)), "components")

    labelled = sig.drop("sketch").join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    smallest = labelled.where("group is not null").groupBy("group").agg(F.min("id").alias("smallest"))
    return stored(labelled.join(smallest, "group", "left").withColumn(
        "component_id", F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("smallest"))), "labelled")
