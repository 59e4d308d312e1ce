"""Benchmark decontamination by word windows.

Every benchmark item gives its windows of ``width`` consecutive words (an item of fewer words, but
not none, is one window). Their hashes go to the tasks as broadcast blocks of a bounded size; each
task hashes all windows of its texts, looks them up, compares the words of every hit with the
window itself, and marks the words that lie in an occurring window.

Defined results: null or empty texts have no words and are clean; items without words or without
an id occur nowhere; an item that is repeated counts once; rows are judged one by one, so repeated
documents are all returned; extra columns are ignored (``scan``) or kept (``decontaminate``);
without items nothing is contaminated; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import append_by_batch, binary_parts, col, fresh, stored
from quarry.llm.hashing import ALNUM, counts_by_text, text_windows

#: Bytes of windows in one broadcast block; a larger benchmark is looked up block by block.
BLOCK_BYTES = 32 << 20

_HIT = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


def item_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window bytes, n words, sorted distinct item ids) of all items."""
    @F.udf(T.ArrayType(T.StructType([T.StructField("w", T.BinaryType()), T.StructField("n", T.IntegerType())])))
    def cut(text):
        words = ALNUM.split(bytes(text or b""))
        n = min(width, len(words))
        return [(b" ".join(words[i:i + n]), n) for i in range(len(words) - n + 1)] if n else []

    return (items.where(col(id_col).isNotNull())
            .select(col(id_col).cast("string").alias("item"), F.explode(cut(col(text_col).cast("binary"))).alias("x"))
            .groupBy(F.col("x.w").alias("w"), F.col("x.n").alias("n"))
            .agg(F.sort_array(F.collect_set("item")).alias("items")))


class Scanner:
    """Finds the windows of one block in slices of texts."""

    def __init__(self, rows):
        self.by_width: dict[int, tuple[np.ndarray, dict]] = {}
        grouped: dict[int, list] = {}
        for w, n, items in rows:
            grouped.setdefault(n, []).append((bytes(w), list(items)))
        for n, group in grouped.items():
            data = np.frombuffer(b"".join(w for w, _ in group), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(w) for w, _ in group])]).astype(np.int64)
            s, e, t = ALNUM.spans(data, offsets)
            at, h = text_windows(ALNUM.hashes(data, s, e), t, n)
            table: dict[int, dict[bytes, list]] = {}
            for k, value in zip(t[at].tolist(), h.tolist(), strict=True):
                table.setdefault(value, {})[group[k][0]] = group[k][1]
            self.by_width[n] = (np.unique(h), table)

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """(words per text, hit word ranges by text, items by text)."""
        starts, ends, text_of = ALNUM.spans(data, offsets)
        n = counts_by_text(text_of, len(offsets) - 1)
        first = np.concatenate([[0], np.cumsum(n)])
        hits: dict[int, list] = {}
        items: dict[int, set] = {}
        if not len(starts):
            return n, hits, items
        words = ALNUM.hashes(data, starts, ends)
        for width, (known, table) in self.by_width.items():
            at, h = text_windows(words, text_of, width)
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for k in np.flatnonzero(known[place] == h).tolist():
                i = int(at[k])
                window = b" ".join(data[starts[i]:ends[i + width - 1]].tobytes().translate(ALNUM.table).split())
                found = table[int(h[k])].get(window)
                if found is not None:
                    doc = int(text_of[i])
                    hits.setdefault(doc, []).append((i - int(first[doc]), i - int(first[doc]) + width))
                    items.setdefault(doc, set()).update(found)
        return n, hits, items


def merged(ranges) -> list[tuple[int, int]]:
    """Overlapping or touching ranges joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(grams: DataFrame) -> list[list]:
    """The windows as broadcastable blocks of at most about BLOCK_BYTES each. The benchmark is
    collected block by block, so the driver holds one block at a time."""
    grams = stored(grams, "grams")
    size = grams.agg(F.sum(F.octet_length("w") + 8 * F.size("items") + 64).alias("b")).first()["b"] or 0
    n = -(-size // BLOCK_BYTES)
    return [(grams.where(F.pmod(F.xxhash64("w"), F.lit(n)) == k) if n > 1 else grams) for k in range(n)]


def add_hits(docs: DataFrame, items: DataFrame, text_col: str, names: tuple[str, str, str], width: int = 10,
             item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with three columns more: number of words (long), merged hit word ranges (array of
    ``from``/``to``), and occurring items (array of string)."""
    n_col, hit_col, item_col = names
    spark = docs.sparkSession
    out = docs
    blocks = _blocks(item_windows(items, item_id, item_text, width)) or [None]
    for k, block in enumerate(blocks):
        rows = [] if block is None else [(bytes(r["w"]), r["n"], list(r["items"])) for r in block.collect()]
        shared = spark.sparkContext.broadcast(rows)
        new = names if k == 0 else tuple(fresh(f"__{x}", out.columns) for x in names)
        made: dict[int, Scanner] = {}

        def scan(texts: pa.Array, shared=shared, made=made):
            scanner = made.get(0) or made.setdefault(0, Scanner(shared.value))
            n, hits, found = scanner.find(*binary_parts(texts))
            spans = [[{"from": a, "to": b} for a, b in merged(hits.get(i, ()))] for i in range(len(n))]
            return [pa.array(n, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                    pa.array([sorted(found.get(i, ())) for i in range(len(n))], pa.list_(pa.string()))]

        out = append_by_batch(out, text_col, [T.StructField(new[0], T.LongType()), T.StructField(new[1], _HIT),
                                              T.StructField(new[2], T.ArrayType(T.StringType()))], scan)
        if k:  # union with what earlier blocks found
            join = F.udf(lambda a, b: merged([tuple(x) for x in [*a, *b]]), _HIT)
            out = stored(out.withColumn(hit_col, join(col(hit_col), col(new[1])))
                         .withColumn(item_col, F.array_sort(F.array_union(col(item_col), col(new[2]))))
                         .drop(*new), "decontam")
    return out


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10,
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row: id, n_words, spans (merged hit word ranges), items."""
    return add_hits(docs.select(col(id_col), col(text_col)), items, text_col, ("n_words", "spans", "items"),
                    width, item_id, item_text).drop(text_col)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", mode: str = "documents",
                  width: int = 10, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with its own columns, without what the benchmark holds: ``mode`` "documents" drops
    every document with a hit word, "spans" cuts from each text the stretch from the first to the
    last word of every hit range."""
    names = tuple(fresh(f"__{x}", docs.columns) for x in ("n", "spans", "items"))
    marked = add_hits(docs, items, text_col, names, width, item_id, item_text)
    if mode == "documents":
        return marked.where(F.size(col(names[1])) == 0).select(*[col(c) for c in docs.columns])
    if mode != "spans":
        raise ValueError(mode)

    @F.udf(T.BinaryType())
    def cut(text, spans):
        if text is None or not spans:
            return text
        raw = bytes(text)
        data = np.frombuffer(raw, np.uint8)
        s, e, _ = ALNUM.spans(data, np.array([0, len(raw)], np.int64))
        keep, last = [], 0
        for x in spans:
            keep.append(raw[last:s[x["from"]]])
            last = int(e[x["to"] - 1])
        return b"".join([*keep, raw[last:]])

    text = F.when(F.size(col(names[1])) == 0, col(text_col)).otherwise(
        cut(col(text_col).cast("binary"), col(names[1])).cast("string"))
    return marked.withColumn(text_col, text).select(*[col(c) for c in docs.columns])
