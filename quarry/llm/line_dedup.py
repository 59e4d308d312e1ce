"""Fuzzy line de-duplication over a corpus by MinHash.

A text's lines (cut at ``\\n``) are compared in a plain form: A-Z lower-cased, white space runs as one
space, trimmed. Lines of equal plain form are one class. A class's set holds the hashes of its
``SHINGLE``-character shingles (a shorter line is one shingle).

1. *Signatures.* ``BANDS * ROWS`` MinHash values: lines of up to ``SHORT`` shingles by one hash function
   for each value, longer ones by one-permutation hashing (the smallest hash in each of as many equal
   parts of the hash range; an empty part takes the next one's). Lines of about ``SHORT`` shingles get
   both kinds, so that no pair falls between.
2. *Bands.* Each band of ``ROWS`` values is hashed; (band hash, class) entries go to buckets as packed
   arrays, with 64 bits of the class and 32 of the hash: what collides adds candidates only. All classes
   that share a band hash are candidates; at similarity 0.8 one pair shares none with probability 0.002.
3. *First candidates.* Each class with the smallest class of its list and with the next one, so a list of
   any length gives at most twice as many pairs as entries (and all pairs up to ``SMALL`` entries). They
   are verified by the exact Jaccard similarity of their sets and merged into components.
4. *Open lists.* Longer lists that still hold several components are compared across them, whole: lists
   beyond ``BLOCK`` classes or ``BLOCK_BYTES`` in pairs of blocks. Sizes and the parity sketches of the sets
   (bits that differ never outnumber the shingles that do) rule out pairs that cannot reach the
   threshold, the others are verified. Only pairs of one component are skipped.
5. *Union-find* (``common.components``) over verified pairs; of each component the first line, by
   document id, then text hash, then line number, is kept, all others go.

Defined results: null text has no lines; lines without characters other than white space are always
kept and compared with nothing; a null id comes first; rows that repeat (id and text) are one document
and get one answer each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import arrow_slices, bucket_of, col, components, fresh, near, pack_sorted, stored, unpack_sorted
from quarry.llm.hashing import mix

SHINGLE = 8
BANDS, ROWS = 16, 5
SHORT = 400
SMALL = 6
#: Entries of one bucket, about.
BUCKET = 1 << 17
#: Classes and bytes of text of one block of an open list, about.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Code points and shingles that one step hashes: its arrays stay in a core's cache.
BLOCK_CODES = 1 << 13
#: Bits of a parity sketch, as a power of 2.
SKETCH = 10

_r = np.random.default_rng(11)
_FACTORS = _r.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = _r.integers(0, 1 << 63, SHINGLE.bit_length() - 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _r.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _r.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def plain_lines(text: bytes) -> list[bytes]:
    """The plain forms of a text's lines. Where single spaces are its only white space, lines are trimmed only."""
    lines = text.lower().split(b"\n")
    if any(x in text for x in (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")):
        return [b" ".join(x.split()) for x in lines]
    return [x.strip(b" ") for x in lines]


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all lines, first place of each line): by code points; every line,
    which is not empty, has one at least. Sums of code points by place, taken for 2, 4 and 8 places."""
    joined = b"\n".join(lines) + b"\n" + bytes(SHINGLE)  # plain lines hold no line breaks
    if joined.isascii():
        flat = np.frombuffer(joined, np.uint8)
    else:
        flat = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(flat == 10)
    first = np.concatenate([[0], ends[:-1] + 1])
    n = ends - first
    total = int(ends[-1])
    h = np.empty(total, np.uint64)
    for at in range(0, total, BLOCK_CODES):
        x = flat[at:min(at + BLOCK_CODES, total) + SHINGLE - 1].astype(np.uint64)
        for k, f in enumerate(_PLACE):
            x = x[:-1 << k] + x[1 << k:] * f
        h[at:at + BLOCK_CODES] = mix(x)
    keep = np.ones(total + 1, bool)
    keep[ends] = False
    short = n < SHINGLE
    for i in np.flatnonzero(short):  # the whole line is its one shingle
        a, b = first[i], ends[i]
        h[a] = mix((flat[a:b] * _SHORT[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))[0]
        keep[a + 1:b] = False
    for k in range(1, SHINGLE):
        keep[ends[~short] - k] = False
    count = np.where(short, 1, n - SHINGLE + 1)
    return h[keep[:total]], np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)


def _band_hashes(sig: np.ndarray, kind: int) -> np.ndarray:
    """(lines, BANDS) from signatures (lines, BANDS * ROWS)."""
    x = (sig.reshape(len(sig), BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64)
    return mix(x + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1 + 100 * kind)) * np.uint64(0x9E3779B97F4A7C15))


def _by_functions(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The smallest values of the upper halves of hashes, times odd factors, for each line. Lines of about
    one length stand side by side, shorter ones with their last hash repeated."""
    sig = np.empty((len(first), BANDS * ROWS), np.uint32)
    top = (h >> np.uint64(32)).astype(np.uint32)
    n = np.diff(np.append(first, len(h)))
    order = np.argsort(n, kind="stable")
    i = 0
    while i < len(order):
        longest = n[order[min(i + BLOCK_CODES * 8 // n[order[i]], len(order) - 1)]]
        own = order[i:i + max(1, BLOCK_CODES * 8 // int(longest))]
        x = top[first[own] + np.minimum(np.arange(n[own[-1]])[:, None], n[own] - 1)]
        y = np.empty_like(x)
        for p, f in enumerate(_FACTORS):
            np.multiply(x, f, out=y)
            rows = len(y)
            while rows > 1:  # halves onto each other
                half = rows // 2
                np.minimum(y[:half], y[rows - half:rows], out=y[:half])
                rows -= half
            sig[own, p] = y[0]
        i += len(own)
    return sig


def _by_parts(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One-permutation values of lines of ``n`` hashes each."""
    parts, none = BANDS * ROWS, np.uint64((1 << 64) - 1)
    cell = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cell += np.repeat(np.arange(0, len(n) * parts, parts), n)
    low = np.full(len(n) * parts, none, np.uint64)
    np.minimum.at(low, cell, h)
    low = low.reshape(-1, parts)
    full = np.where(low != none, np.arange(parts), 2 * parts)
    # an empty part takes the next full one, around the end
    nxt = np.minimum.accumulate(np.concatenate([full, full + parts], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :parts] % parts
    return np.take_along_axis(low, nxt, axis=1) + (nxt - np.arange(parts)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def bands(lines: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(line numbers, their band hashes) for both kinds of signatures."""
    h, first = shingles(lines)
    n = np.diff(np.append(first, len(h)))
    out = []
    short = np.flatnonzero(n <= SHORT * 5 // 4)
    if len(short):
        starts = np.concatenate([[0], np.cumsum(n[short])[:-1]])
        out.append((short, _band_hashes(_by_functions(h[np.repeat(n <= SHORT * 5 // 4, n)], starts), 0)))
    long_ = np.flatnonzero(n > SHORT * 4 // 5)
    if len(long_):
        out.append((long_, _band_hashes(_by_parts(h[np.repeat(n > SHORT * 4 // 5, n)], n[long_]), 1)))
    return out


def similarities(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """The Jaccard similarity of each pair of lines, by one sort for all pairs: the pair's number stands above
    44 bits of its hashes. Pairs of long lines, whose hashes might meet in these, are taken one by one."""
    h, first = shingles(xs + ys)
    count = np.diff(np.append(first, len(h)))
    n = len(xs)
    out = np.zeros(n)
    long_ = np.maximum(count[:n], count[n:]) > 10 * SHORT
    for i in np.flatnonzero(long_):
        out[i] = similarity(h[first[i]:first[i] + count[i]], h[first[n + i]:first[n + i] + count[n + i]])
    for at in range(0, n, 1 << 20):  # numbers have 20 bits
        end = min(at + (1 << 20), n)

        def sets(of: int) -> np.ndarray:
            size = count[of + at:of + end]
            z = first[of + at]
            keys = np.repeat(np.arange(end - at, dtype=np.uint64) << np.uint64(44), size) | (h[z:z + size.sum()] >> np.uint64(20))
            keys = np.sort(keys[np.repeat(~long_[at:end], size)])
            return keys[np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0]

        merged = np.sort(np.concatenate([sets(0), sets(n)]))
        both, each = (np.bincount((k >> np.uint64(44)).astype(np.int64), minlength=end - at) for k in (merged[1:][merged[1:] == merged[:-1]], merged))
        fine = ~long_[at:end]
        out[at:end][fine] = both[fine] / (each - both)[fine]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_LINE = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("line", T.IntegerType()),
                      T.StructField("cls", T.BinaryType())])
_PACK = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("packed", T.BinaryType())])
_FOUND = T.StructType([T.StructField("list", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_LINK = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
_TEXT = T.StructType([T.StructField("c", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("plain", T.BinaryType())])


def _class(p: bytes) -> bytes:
    return hashlib.blake2b(p, digest_size=16).digest()


def occurrences(src: DataFrame) -> DataFrame:
    """(id, h, line, cls) of every line of ``src(id, h, text)``; cls is null for blank lines."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in arrow_slices(batches, 2):
            ids, hs, nos, cls = [], [], [], []
            for i, h, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if text is not None:
                    lines = plain_lines(text)
                    ids += [i] * len(lines)
                    hs += [h] * len(lines)
                    nos += range(len(lines))
                    cls += [_class(p) if p else None for p in lines]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.int64()), pa.array(nos, pa.int32()), pa.array(cls, pa.binary())],
                                             names=_LINE.names)
    return src.mapInArrow(run, _LINE)


def candidates(src: DataFrame, buckets: int) -> DataFrame:
    """(null, a, b): first candidates; (list, class, null): the entries of lists beyond ``SMALL``."""
    def emit(batches: Iterator[pa.RecordBatch]):
        seen: set[bytes] = set()
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def flush():
            bucket, low = bucket_of(np.concatenate(keys), buckets)
            o = np.lexsort((low, bucket))
            c, bucket, low = np.concatenate(owners)[o], bucket[o], low[o]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            packed = [pack_sorted(low[x:y]) + c[x:y].tobytes() for x, y in zip(cut, [*cut[1:].tolist(), len(low)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(packed, pa.binary())], names=_PACK.names)

        for piece in arrow_slices(batches, 2):
            new: dict[bytes, bytes] = {}
            for text in piece.column(2).to_pylist():
                if text is not None:
                    for p in plain_lines(text):
                        if p:
                            c = _class(p)
                            if c not in seen:
                                seen.add(c)
                                new[c] = p
            if new:
                ids = np.frombuffer(b"".join(c[:8] for c in new), np.uint64)
                for at, hashes in bands(list(new.values())):
                    keys.append(hashes.reshape(-1))
                    owners.append(np.repeat(ids[at], BANDS))
                    size += hashes.size
            if size > 1_500_000:
                yield flush()
                seen, keys, owners, size = set(), [], [], 0
        if size:
            yield flush()

    def pair(t: pa.Table) -> pa.Table:
        ks, cs = [], []
        for x in t.column("packed"):
            raw = x.as_buffer()
            n = raw.size // 12
            ks.append(unpack_sorted(raw, n))
            cs.append(np.frombuffer(raw, np.uint64, n, 4 * n))
        k, c = np.concatenate(ks), np.concatenate(cs)
        o = np.lexsort((c, k))
        k, c = k[o], c[o]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[new], c[new]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff([*cut, len(k)])
        start, n = np.repeat(cut, size), np.repeat(size, size)
        i = np.arange(len(k))
        a, b = [i[i > start]], [start[i > start]]  # with the list's smallest class
        a.append(i[i > start + 1])
        b.append(i[i > start + 1] - 1)  # with the one before
        for d in range(2, SMALL):  # short lists: all pairs
            ok = (n <= SMALL) & (i - d > start)
            a.append(i[ok])
            b.append(i[ok] - d)
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([c[b], c[a]], axis=1), axis=0).view(np.int64) if len(a) else np.zeros((0, 2), np.int64)
        long_ = n > SMALL
        name = np.int64(t.column("bucket")[0].as_py() << 32) | k[long_].astype(np.int64)
        return pa.table({"list": pa.concat_arrays([pa.nulls(len(both), pa.int64()), pa.array(name, pa.int64())]),
                         "a": pa.array(np.concatenate([both[:, 0], c[long_].view(np.int64)]), pa.int64()),
                         "b": pa.concat_arrays([pa.array(both[:, 1], pa.int64()), pa.nulls(len(name), pa.int64())])})

    # band hashes are even, so buckets are: an entry for each class and band, whatever repeats
    return src.mapInArrow(emit, _PACK).groupBy("bucket").applyInArrow(pair, _FOUND).distinct()


def class_texts(src: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, cls, plain form) of the classes with the given 64 bits ``classes(c)``."""
    def run(batches: Iterator[pa.RecordBatch]):
        seen: set[bytes] = set()
        for b in arrow_slices(batches, 2):
            found: dict[bytes, bytes] = {}
            for text in b.column(2).to_pylist():
                if text is not None:
                    for p in plain_lines(text):
                        if p and (c := _class(p)) not in seen:
                            seen.add(c)
                            found[c] = p
            if len(seen) > 1_000_000:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(c[:8] for c in found), np.int64), pa.int64()),
                                              pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=_TEXT.names)

    lines = src.mapInArrow(run, _TEXT).join(near(classes), "c", "left_semi")
    return lines.groupBy("c", "cls").agg(F.first("plain").alias("plain"))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (as classes) whose sets reach the threshold."""
    x = texts.select(F.col("c").alias("a"), F.col("cls").alias("x_cls"), F.col("plain").alias("x")).join(near(pairs), "a")
    y = texts.select(F.col("c").alias("b"), F.col("cls").alias("y_cls"), F.col("plain").alias("y")).join(near(pairs.select("b").distinct()), "b", "left_semi")
    rows = x.join(y, "b").where("x_cls <> y_cls").select("x_cls", "y_cls", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in arrow_slices(batches, 2):
            ok = similarities(b.column(2).to_pylist(), b.column(3).to_pylist()) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=_LINK.names).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, _LINK)


def sketches(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, words) parity sketches of sets of distinct hashes ``h``, ``n`` of each: a bit tells whether an
    odd number of hashes falls to it, so two sketches differ in at most as many bits as the sets in hashes."""
    at = np.repeat(np.arange(len(n)) << SKETCH, n) + (h >> np.uint64(64 - SKETCH)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(n) << SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(n), -1), axis=1).view(np.uint64)


def links_across(sets: list[np.ndarray], comp: np.ndarray, block: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs that reach the threshold and join the components ``comp`` (numbers) as all such pairs would,
    in one block or, if there are two, across them."""
    n = np.array([len(s) for s in sets])
    bits = sketches(np.concatenate(sets), n)
    root, out = comp.copy(), []
    across = block.min() != block.max()
    count = np.bincount(comp)
    order = np.argsort(count[comp], kind="stable")  # members of the largest component meet all others, not each other
    last = len(order) - (int(count.max()) if (count == count.max()).sum() == 1 else 0)
    for x, i in enumerate(order[:last]):
        j = order[x + 1:]
        j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]) - 1e-6)]
        if across:
            j = j[block[j] != block[i]]
        if len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            for k in j[apart <= (n[j] + n[i]) * (1 - threshold) / (1 + threshold) + 1e-6]:
                if root[k] != root[i]:
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if both / (n[i] + n[k] - both) >= threshold:
                        root[root == root[k]] = root[i]
                        out.append((int(i), int(k)))
    return out


def open_links(lists: DataFrame, texts: DataFrame, comp: DataFrame, threshold: float) -> DataFrame | None:
    """Verified pairs between components within ``lists(list, c)``; ``comp(cls, component)`` has the classes
    of components of two and more."""
    texts = texts.join(comp, "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    who = stored(texts.select("c", "comp", F.octet_length("plain").alias("size")), "line-components")
    mixed = (lists.join(near(who), "c").groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.sum("size").alias("size"))
             .where("low <> high").select("list", "n", "size", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks")))
    mixed = stored(mixed, "open-lists")
    total = mixed.agg(F.sum(F.col("n") * F.col("blocks")).alias("n"), F.sum(F.col("size") * F.col("blocks")).alias("size")).first()
    if not total["n"]:
        return None
    groups = max(64, total["n"] // (4 * BLOCK), total["size"] // (4 * BLOCK_BYTES))
    rows = (lists.join(near(mixed.select("list", "blocks")), "list").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("list", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    rows = rows.join(texts.select("c", "cls", "comp", "plain"), "c").select("list", "i", "j", "block", "cls", "comp", "plain")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("list", "ascending"), ("i", "ascending"), ("j", "ascending"), ("cls", "ascending")])
        cls, at, sets = t.column("cls").to_pylist(), {}, []
        texts_of = {c: p for c, p in zip(cls, t.column("plain").to_pylist(), strict=True)}
        names = list(texts_of)
        for a in range(0, len(names), 4096):
            h, first = shingles([texts_of[c] for c in names[a:a + 4096]])
            for c, x, y in zip(names[a:a + 4096], first, [*first[1:], len(h)], strict=True):
                at[c] = len(sets)
                sets.append(np.unique(h[x:y]))
        which = np.array([at[c] for c in cls])
        comp_no: dict[bytes, int] = {}
        number = np.array([comp_no.setdefault(x, len(comp_no)) for x in t.column("comp").to_pylist()])
        block = t.column("block").to_numpy()
        key = np.stack([t.column(k).to_numpy() for k in ("list", "i", "j")], axis=1)
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])).tolist()
        out = []
        for x, y in zip(cut, [*cut[1:], len(cls)], strict=True):
            own = np.unique(number[x:y], return_inverse=True)[1].reshape(-1)
            if own.max() > 0 and (key[x, 1] == key[x, 2] or block[x:y].min() != block[x:y].max()):
                out += [(cls[x + a], cls[x + b]) for a, b in links_across([sets[k] for k in which[x:y]], own, block[x:y], threshold)]
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return rows.groupBy(F.pmod(F.xxhash64("list", "i", "j"), F.lit(groups)).alias("group")).applyInArrow(run, _LINK)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Per document row: id, ``n_lines``, ``kept`` (line numbers from 0, in order) and the text's hash
    ``h`` that tells documents of one id apart."""
    src = docs.select(col(id_col).cast("long").alias("id"), F.xxhash64(col(text_col).cast("binary")).alias("h"), col(text_col).cast("binary").alias("text"))
    seen = stored(occurrences(src), "lines")
    n = seen.count()
    found = stored(candidates(src, max(64, n * BANDS // BUCKET)), "pairs")
    pairs = found.where("list is null").select("a", "b")
    texts = stored(class_texts(src, stored(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct(), "involved")), "line-texts")
    links = stored(verified(pairs, texts, threshold), "links")
    comp = components(links).select(F.col("node").alias("cls"), "component")
    more = open_links(found.where("list is not null").select("list", F.col("a").alias("c")), texts, comp, threshold)
    if more is not None:
        more = stored(more, "open-links")
        if not more.isEmpty():
            comp = components(links.union(more)).select(F.col("node").alias("cls"), "component")
    first = seen.where("cls is not null").groupBy("cls").agg(F.min(F.struct("id", "h", "line")).alias("at"))
    first = first.join(comp, "cls", "left").groupBy(F.coalesce("component", "cls").alias("group")).agg(F.min("at").alias("at"))
    kept = (first.select("at.*").union(seen.where("cls is null").select("id", "h", "line").distinct())
            .groupBy("id", "h").agg(F.sort_array(F.collect_list("line")).alias("kept")))
    rows = src.select("id", "h", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count(F.col("text").cast("string"), F.lit("\n")) + 1).cast("long").alias("n_lines"))
    kept = kept.select(F.col("id").alias("kid"), F.col("h").alias("kh"), "kept")
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")), "left")
    return out.select(F.col("id").alias(id_col), "h", "n_lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def rewrite(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with only the kept lines in the text; null texts stay null."""
    key, h, kept = (fresh(x, docs.columns) for x in ("__id", "__h", "__kept"))
    d = decisions.select(F.col(id_col).alias(key), F.col("h").alias(h), F.col("kept").alias(kept)).dropDuplicates([key, h])
    rows = docs.join(d, col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(col(text_col).cast("binary")) == F.col(h)), "left")
    lines = F.split(col(text_col), "\n", -1)
    text = F.array_join(F.transform(F.col(kept), lambda i: F.element_at(lines, i + 1)), "\n")
    return rows.withColumn(text_col, F.when(col(text_col).isNotNull(), text)).select(*[col(c) for c in docs.columns])
