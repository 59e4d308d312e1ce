"""Filter interaction audit by truth-table survival words.

Five filters give each document a failure mask. Its survival word has one bit for each of the 32
subsets of the filters: set if the document passes all of the subset. How many documents survive a
subset, for each part and label, is the number of set bits at its place over all words: a positional
popcount, taken in numpy with carry-save adders on whole words (three words of one weight become a
sum of that weight and a carry of twice the weight) and added up by Spark. Everything asked of any
order of the filters follows from those 32 numbers a part: a filter removes, after others, what
survives the others less what survives them together with it.

The texts are read once: a written table holds id, part, four bits and the text's digest. The filter of
exact copies takes the smallest id for each digest (combined on the map side, so a text that a third
of all documents share is one row a task); the join back hints at a broadcast only for a counted
number of copied digests, else AQE splits a hot one.

Defined results: null texts are empty, null parts the empty string; a null id has no smaller one and
no label; equal rows are counted each, and do not make each other copies; a document with several label
rows is good or toxic if one of them says so; a part without failures has zeros; an empty table gives
an empty result; further columns are not read and may have any name.
"""

from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import col, near, stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: For each failure mask the word of the subsets that a document survives.
SURVIVAL = [sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)]
COUNTS = [f"c{s}" for s in range(SUBSETS)]


def text_failures(text: Column, words: Column) -> Column:
    """Bits of the four filters that look at one text: under 50 words, few distinct words, many
    capitals, symbols."""
    n = F.size(words)
    fails = [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n,
             100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def survival_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, good, toxic, word`` (the 32 bits as a long) for each row of ``docs(doc_id, text,
    source)``; ``labels(doc_id, quality, toxic)``."""
    text = F.coalesce(col("text"), F.lit(""))
    cut = docs.select(col("doc_id").alias("doc_id"), F.coalesce(col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"),
                      F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("words"))
    seen = stored(cut.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), text_failures(F.col("t"), F.col("words")).alias("mask")), "audit")
    copied = stored(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
                    .select("digest", "first"), "audit-copies")
    marks = (labels.where("doc_id is not null").groupBy(col("doc_id").alias("labelled"))
             .agg((F.max(F.when(col("quality") == 1, 1)) == 1).alias("good"), (F.max(F.when(col("toxic") == 1, 1)) == 1).alias("toxic")))
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    table = F.array(*[F.lit(w).cast("long") for w in SURVIVAL])
    return (seen.join(near(copied), "digest", "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
            .select("doc_id", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
                    F.get(table, F.col("mask") + copy).alias("word")))


def popcounts(words: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Set bits at each of 32 places for each group: ``words`` (uint32) in the order of ``group``. At each
    weight, triples within a group go through a carry-save adder until a group has two words at most;
    those are counted, the carries are the words of the next weight."""
    out, weight = np.zeros((groups, 32), np.int64), 1
    x, g = words, group
    while len(x):
        carries, carried = [np.zeros(0, np.uint32)], [np.zeros(0, g.dtype)]
        while True:
            size = np.bincount(g, minlength=groups)
            place = np.arange(len(g)) - (np.cumsum(size) - size)[g]
            whole = place < (size // 3 * 3)[g]
            lead = np.flatnonzero(whole & (place % 3 == 0))
            if not len(lead):
                break
            a, b, c = x[lead], x[lead + 1], x[lead + 2]
            half = a ^ b
            carries.append((a & b) | (half & c))
            carried.append(g[lead])
            x, g = np.concatenate([half ^ c, x[~whole]]), np.concatenate([g[lead], g[~whole]])
            order = np.argsort(g, kind="stable")
            x, g = x[order], g[order]
        np.add.at(out, g, weight * ((x[:, None] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64))
        x, g = np.concatenate(carries), np.concatenate(carried)
        order = np.argsort(g, kind="stable")
        x, g, weight = x[order], g[order], 2 * weight
    return out


def _count_batches(batches):
    names = ["part", "good", "toxic", *COUNTS]
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0).dictionary_encode()
        kind = 2 * b.column(1).cast(pa.int8()).to_numpy(zero_copy_only=False) + b.column(2).cast(pa.int8()).to_numpy(zero_copy_only=False)
        key = 4 * part.indices.to_numpy(zero_copy_only=False).astype(np.int64) + kind
        keys, group = np.unique(key, return_inverse=True)
        order = np.argsort(group, kind="stable")
        counts = popcounts(b.column(3).to_numpy().astype(np.uint32)[order], group[order], len(keys))
        yield pa.RecordBatch.from_arrays([part.dictionary.take(pa.array(keys // 4)), pa.array(keys % 4 > 1), pa.array(keys % 2 > 0),
                                          *[pa.array(counts[:, s]) for s in range(SUBSETS)]], names=names)


def subset_counts(words: DataFrame) -> DataFrame:
    """``part, good, toxic, c0 .. c31``: documents that survive each subset of the filters (bit k of a
    subset's number: the filter ``FILTERS[k]``)."""
    schema = "part string, good boolean, toxic boolean, " + ", ".join(f"{c} long" for c in COUNTS)
    return (words.select("part", "good", "toxic", "word").mapInArrow(_count_batches, schema)
            .groupBy("part", "good", "toxic").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def _steps() -> str:
    """Each order's steps: letter's number, filters before."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            rows.append({"filter_order": "".join(FILTERS[x] for x in order), "step": k + 1, "f": f, "before": sum(1 << x for x in order[:k])})
    return json.dumps(rows)


def report(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, see the module."""
    sums = lambda when: F.array(*[F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)) for c in COUNTS])
    parts = counts.groupBy("part").agg(sums(F.lit(True)).alias("n"), sums(F.col("good")).alias("g"), sums(F.col("toxic")).alias("t"))

    def worth(f: int) -> Column:  # removed by f after each set of others, in so many orders
        terms = [math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << f)))
                 for s in range(SUBSETS) if not s >> f & 1]
        return sum(terms, F.lit(0))

    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,f:int,before:int>>")
    rows = (parts.withColumn("worth", F.array(*[worth(f) for f in range(len(FILTERS))]))
            .select("*", F.explode(steps).alias("s")).select("part", "n", "g", "t", "worth", "s.*")
            .withColumn("own", F.expr("shiftleft(1, f)")).withColumn("after", F.col("before").bitwiseOR(F.col("own"))))
    lost = lambda a: F.get(a, F.col("before")) - F.get(a, F.col("after"))
    rest = F.lit(SUBSETS - 1) - F.col("own")
    return rows.select("part", "filter_order", "step", F.get("n", F.col("after")).alias("kept"), lost("n").alias("removed"),
                       (F.get("n", F.lit(0)) - F.get("n", F.col("own")) - lost("n")).alias("redundant"),
                       (F.get("n", rest) - F.get("n", F.lit(SUBSETS - 1))).alias("unique_fails"),
                       lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), F.get("worth", F.col("f")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return report(subset_counts(survival_words(docs, labels)))
