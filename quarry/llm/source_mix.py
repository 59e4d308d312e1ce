"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to).
A network routes word capacity from patterns to source quotas: the first copy of a pattern's words
costs nothing, each further copy one unit more (convex, so parallel edges), up to ``max_repeats``
copies. What the flow asks of a pattern is then taken by a seeded choice of whole documents: every
document gets the full copies, and the rest goes to documents in the order of a seeded hash.

Memory: the driver sees one row for each source and one for each pattern. The seeded choice cuts
each pattern into hash bins; only the one bin in which the quota ends is walked row by row, so a
pattern with a third of all documents makes no larger group than others.

Defined results: null text has size 0; a null source is a source of its own, last in order; empty
tables give empty results; repeated rows are documents of their own; a document without words
takes none and appears once; ``mix`` ignores other columns, ``mixed`` keeps them.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import col, stored

#: Documents of a hash bin, on average, up to a million documents; beyond, bins and the documents
#: of one bin both grow with the square root.
BIN_ROWS = 1000


def word_count(text) -> F.Column:
    """Number of runs of anything but space and \\t \\n \\v \\f \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight, none above ``cap`` times its own size; what is
    above is shared again by weight among the others until none is above. Exact fractions inside."""
    left = Fraction(share).limit_denominator(10**6) * sum(sizes)
    cap = Fraction(cap).limit_denominator(10**6)
    w = [Fraction(x).limit_denominator(10**6) for x in weights]
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        unit = left / sum(w[i] for i in open_) if sum(w[i] for i in open_) else Fraction(0)
        over = [i for i in open_ if unit * w[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * w[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= set(over)
    return [float(x) for x in out]


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], max_repeats: int) -> list[list[int]]:
    """Words routed from each pattern (members, size) to each source. Successive shortest paths with
    potentials: patterns offer ``size`` words at cost 0, 1, ... ``max_repeats - 1``; as many words as
    possible reach the quotas, at the least total cost."""
    n_p, n_s = len(patterns), len(quotas)
    source, sink = n_p + n_s, n_p + n_s + 1
    to, cap, cost, out = [], [], [], [[] for _ in range(n_p + n_s + 2)]

    def edge(a, b, c, w):
        out[a].append(len(to)); to.append(b); cap.append(c); cost.append(w)
        out[b].append(len(to)); to.append(a); cap.append(0); cost.append(-w)

    routes = []
    for p, (members, size) in enumerate(patterns):
        for r in range(max_repeats):
            edge(source, p, size, r)
        for s in members:
            routes.append((p, s, len(to)))
            edge(p, n_p + s, max_repeats * size, 0)
    for s, q in enumerate(quotas):
        edge(n_p + s, sink, q, 0)
    height = [0] * len(out)
    while True:
        dist: list[float] = [float("inf")] * len(out)
        back = [-1] * len(out)
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                if cap[e] > 0 and (x := d + cost[e] + height[a] - height[to[e]]) < dist[to[e]]:
                    dist[to[e]], back[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if dist[sink] == float("inf"):
            break
        for i, d in enumerate(dist):
            height[i] += int(min(d, dist[sink]))
        path, b = [], sink
        while b != source:
            path.append(back[b])
            b = to[back[b] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow = [[0] * n_s for _ in patterns]
    for p, s, e in routes:
        flow[p][s] = cap[e ^ 1]
    return flow


def mix(docs: DataFrame, weights, share: float = 1.5, max_repeats: int = 2, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", members=None) -> DataFrame:
    """One row per document: the id, ``size``, ``source_size`` and ``target`` (of its first member
    source), ``taken`` (words, repeats counted) and ``copies`` (0..max_repeats). ``members`` is an
    array-of-string column of the sources a document belongs to (default: the one in ``source``);
    ``weights(i)`` is the weight of the i-th source, sources ordered by code point with null last."""
    rows, copies = _chosen(docs, weights, share, max_repeats, seed, id_col, text_col, members, [id_col])
    return rows.select(F.col("k0").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights, share: float = 1.5, max_repeats: int = 2, seed: int = 17,
          id_col: str = "doc_id", text_col: str = "text", members=None) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    rows, copies = _chosen(docs, weights, share, max_repeats, seed, id_col, text_col, members, docs.columns)
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])


def _chosen(docs, weights, share, max_repeats, seed, id_col, text_col, members, keep):
    """(rows, the expression of their copies): columns ``k0, k1, ...`` hold those in ``keep``."""
    spark = docs.sparkSession
    members = F.array(col("source").cast("string")) if members is None else members
    flat = [f"k{i}" for i in range(len(keep))]
    ordered = F.array_sort(F.array_distinct(members))  # null last
    base = docs.select(*[col(c).alias(f) for c, f in zip(keep, flat, strict=True)], ordered.alias("members"),
                       F.array_join(F.transform(ordered, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("-"))), "\0").alias("pattern"),
                       word_count(col(text_col)).alias("size"), F.xxhash64(F.lit(seed), col(id_col), col(text_col)).alias("h"))

    sizes_of = stored(base.select("members", "pattern", "size", "h"), "sizes")  # words are counted once for all totals
    groups = (sizes_of.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size"), F.count("*").alias("n"))
              .orderBy("pattern").collect())
    names = sorted({s for g in groups for s in g["members"]}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for g in groups:
        for s in g["members"]:
            sizes[at[s]] += g["size"]
    goal = targets(sizes, [weights(i) for i in range(len(names))], share, max_repeats)
    patterns = [(tuple(at[s] for s in g["members"]), g["size"]) for g in groups]
    flow = min_cost_flow(patterns, [round(x) for x in goal], max_repeats)

    # for each pattern: full copies of all its documents, and one more of some (``rest`` words)
    plan = []
    for g, (mem, size), f in zip(groups, patterns, flow, strict=True):
        quota = sum(f)
        full = min(max_repeats, quota // size) if size else 0
        plan.append((g["pattern"], sizes[mem[0]] if mem else 0, goal[mem[0]] if mem else 0.0, int(full),
                     int(quota - full * size), max(1, min(math.isqrt(g["n"]), g["n"] // BIN_ROWS))))
    plan = spark.createDataFrame(plan, "pattern string, source_size long, target double, full int, rest long, bins int")

    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))

    def placed(df: DataFrame) -> DataFrame:  # the plan has a row for each pattern: texts stay where they are
        return (df.drop("members").join(F.broadcast(plan), "pattern").withColumn("place", place)
                .withColumn("bin", F.floor(F.col("place") * F.col("bins")).cast("int")))

    rows = placed(base)
    by_bin = placed(sizes_of).groupBy("pattern", "bin", "rest").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("pattern").orderBy("bin")) - F.col("size")
    ends = by_bin.withColumn("before", before).where("before <= rest and before + size > rest").collect()  # one row for each pattern
    ends = spark.createDataFrame([(r["pattern"], r["bin"], r["rest"] - r["before"]) for r in ends], "pattern string, end_bin int, open long")
    rows = rows.join(F.broadcast(ends), "pattern", "left")

    sized = ["size", "source_size", "target"]
    out_schema = T.StructType([T.StructField(f, docs.schema[c].dataType) for c, f in zip(keep, flat, strict=True)]
                              + [T.StructField("size", T.LongType()), T.StructField("source_size", T.LongType()),
                                 T.StructField("target", T.DoubleType()), T.StructField("copies", T.IntegerType())])

    def fill(t: pa.Table) -> pa.Table:
        """The bin in which the quota ends, in seeded order: a document that would overshoot is
        passed over, later ones fill the rest; then the one exchange (or addition) of documents that
        brings the sum nearest to the quota is made."""
        t = t.sort_by([("place", "ascending"), ("size", "ascending")])
        left, size = t.column("open")[0].as_py(), t.column("size").to_numpy()
        extra = np.zeros(len(size), np.int32)
        for i, n in enumerate(size.tolist()):
            if n <= left:
                extra[i] = 1
                left -= n
        out = np.flatnonzero(extra == 0)
        if left and len(out):
            out = out[np.argsort(size[out], kind="stable")]
            taken = np.concatenate([[-1], np.flatnonzero(extra)])  # -1: nothing is given back
            given = np.where(taken < 0, 0, size[taken])
            want = given + left
            at = np.searchsorted(size[out], want)
            miss = np.stack([np.abs(size[out[np.clip(at - d, 0, len(out) - 1)]] - want) for d in (0, 1)])
            d, i = np.unravel_index(int(miss.argmin()), miss.shape)
            if miss[d, i] < left:
                extra[out[np.clip(at[i] - d, 0, len(out) - 1)]] = 1
                if taken[i] >= 0:
                    extra[taken[i]] = 0
        copies = pc.add(t.column("full"), pa.array(extra))
        return t.select([*flat, *sized]).append_column("copies", copies)

    cut = (rows.where("bin = end_bin").select("pattern", *flat, *sized, "full", "open", "place")
           .groupBy("pattern").applyInArrow(fill, out_schema))
    more = F.when(F.col("end_bin").isNull(), F.col("rest") > 0).otherwise(F.col("bin") < F.col("end_bin"))
    sure = (rows.where("end_bin is null or bin <> end_bin")
            .select(*flat, *sized, (F.col("full") + more.cast("int")).alias("copies")))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    return sure.unionByName(cut), copies
