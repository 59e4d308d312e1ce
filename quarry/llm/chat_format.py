"""Reply trees as training conversations.

Messages form trees (node, parent). Ancestor tables are built by repeated self-joins, each doubling
the distance (1, 2, 4, ... replies), so a thread of n replies takes log2(n) joins of ids and scores;
texts stay out of them. Root-to-leaf paths are ranked by the sum of their nodes' scores, the best
``top`` of each tree are kept, their members are read off the ancestor tables, and each path is
formatted as one conversation.

Template: each turn is ``### Role:`` and a line break, the escaped text, and ``</turn>`` with a line
break. Inside a text every backslash, ``#`` and ``<`` is written with a backslash in front of it, so
no control string can stand there; ``unescape`` undoes it exactly. The loss mask covers the escaped
text of assistant turns.

Defined results: null text or role is empty; a node whose parent is null
or unknown is a root; nodes on a cycle have no root and give no path; repeated nodes are made
distinct by the caller (``conversations_as_trees`` numbers them); ties between paths go to the
smaller leaf; extra columns are ignored; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import col, map_batches, stored

HEAD, END = "### ", "</turn>"


def escape(text: str) -> str:
    """Backslash, ``#`` and ``<`` (with which every control string starts) get a backslash."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        out.append(text[j + 1:j + 2])
        i = j + 2
    out.append(text[i:])
    return "".join(out)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and its loss mask as [start, end) ranges of code points."""
    parts, at, mask = [], 0, []
    for role, text in turns:
        head = f"{HEAD}{escape(role).replace(chr(10), chr(92) + chr(10)).replace(':', chr(92) + ':')}:\n"
        body = escape(text)
        parts += [head, body, END, "\n"]
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the string. Control strings inside texts and roles are escaped, so an
    unescaped ``:`` ends a role and an unescaped ``<`` ends a text."""
    turns, i = [], 0
    while i < len(formatted):
        if not formatted.startswith(HEAD, i):
            raise ValueError(f"no turn at {i}")
        j = _plain(formatted, ":\n", i + len(HEAD))
        k = _plain(formatted, END + "\n", j + 2)
        turns.append((unescape(formatted[i + len(HEAD):j]), unescape(formatted[j + 2:k])))
        i = k + len(END) + 1
    return turns


def _plain(s: str, mark: str, i: int) -> int:
    """Place of the first ``mark`` that no odd run of backslashes precedes."""
    while (j := s.find(mark, i)) >= 0:
        n = j
        while n > i and s[n - 1] == "\\":
            n -= 1
        if (j - n) % 2 == 0:
            return j
        i = j + 1
    raise ValueError(f"no {mark!r}")


def root_to_leaf(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Members of the best ``top`` paths of each tree: ``(tree, leaf, rank, place, node)``, place 0
    being the root. ``nodes(tree, node, parent, score)``; nodes are unique within a tree."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(1).alias("here"))
    hop = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("here") == 1, F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    levels = []  # level j: (node, its ancestor 2^j replies above)
    hop = stored(hop, "hops")
    # the ancestor reached so far, the scores of the nodes below it, and how many they are
    far = hop.select("tree", "node", "up", "total", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("dist"))
    size = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    # nodes that have reached their root stay aside, so each round works on the longer threads only
    while len(levels) <= size.bit_length():
        active = far.where("up is not null")
        if not active.limit(1).count():
            break
        levels.append(active.select("tree", "node", "up"))
        step = far.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("dist").alias("d2"))
        moved = active.join(step, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("dist") + F.col("d2")).alias("dist"))
        far = stored(moved.unionByName(far.where("up is null")), "hops")
    parents = hop.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = far.where("up is null").join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    if top == 1:  # combined on the map side
        best = (leaves.groupBy("tree").agg(F.max_by(F.struct("node", "dist"), F.struct("total", -F.col("node"))).alias("b"))
                .select("tree", F.col("b.node").alias("node"), F.col("b.dist").alias("dist"), F.lit(1).alias("rank")))
    else:
        best = leaves.withColumn("rank", rank).where(F.col("rank") <= top).select("tree", "node", "dist", "rank")
    found = best.select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("dist").alias("place"))
    for j in reversed(range(len(levels))):
        up = found.join(levels[j], ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("place") - (1 << j)).alias("place"))
        found = stored(found.unionByName(up), "paths")
    return found


def conversations_as_trees(conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Plain conversations as chains: rows by turn (null first; equal turns by role and text), each
    row the reply to the one before. ``tree`` is the id as a string, ``null`` for a null id."""
    w = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text")
    node = F.row_number().over(w).cast("long")
    rows = conv.select(F.coalesce(col(id_col).cast("string"), F.lit("null")).alias("tree"), col(turn_col).cast("long").alias("turn"),
                       F.coalesce(col("role"), F.lit("")).alias("role"), F.coalesce(col("text"), F.lit("")).alias("text"))
    return rows.withColumn("node", node).withColumn("parent", F.when(node > 1, node - 1)).withColumn("score", F.lit(0.0))


_OUT = T.StructType([T.StructField("tree", T.StringType()), T.StructField("leaf", T.LongType()), T.StructField("rank", T.IntegerType()),
                     T.StructField("formatted", T.StringType()),
                     T.StructField("mask", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])))])


def format_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``messages(tree, node, parent, role, text, score)`` -> one row for each kept path:
    ``tree, leaf, rank, formatted, mask``. A path is one conversation, that is one value, so its
    turns meet in one row; nothing else does."""
    messages = stored(messages, "messages")
    paths = root_to_leaf(messages.select("tree", "node", "parent", "score"), top)
    rows = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [render([(t["role"], t["text"]) for t in turns]) for turns in b.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s for s, _ in done], pa.string()),
                                           pa.array([[{"from": a, "to": z} for a, z in m] for _, m in done],
                                                    pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], names=_OUT.names)

    return map_batches(turns.select("tree", "leaf", "rank", "turns"), _OUT, run)


def digests(formatted: DataFrame) -> DataFrame:
    """What the strings hold, read back from them alone: turns, and the text under the loss mask."""
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for tree, s, mask in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse(s)
            loss = "".join(unescape(s[m["from"]:m["to"]]) for m in mask)
            rows.append({"conv_id": None if tree == "null" else int(tree), "n_turns": len(turns),
                         "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                         "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(s)})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64())
                                                                  for f in schema.fields]))

    return map_batches(formatted.select("tree", "formatted", "mask"), schema, run)
