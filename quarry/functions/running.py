"""Running sums and numbers within groups of any size.

A window over a group is one task's work, however large the group. Here rows are dealt by ranges of
(group, order), so a large group lies in several ranges; sums run within each range, and a group's sum
of the ranges before is added. A range border splits one group at most, so there are fewer such
offsets than ranges, and they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stored


def running_sum(df: DataFrame, group: str, order: list[str], value: Column, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (a long, not null) over the rows of ``group`` up to and with
    this one, in ``order``. Rows that tie in ``order`` are taken one after the other, in any order; null
    groups are one group. The rows are written once, so that ties stay as they are."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = {c.lower() for c in df.columns}
    part, tie, before, p, g = (next(x for x in (name + "_" * k for k in range(99)) if x not in names) for name in ("part", "tie", "before", "p", "g"))
    ranged = df.withColumn(out, value.cast("bigint")).repartitionByRange(n, group, *order)
    ranged = stored(ranged.withColumn(part, F.spark_partition_id()).withColumn(tie, F.monotonically_increasing_id()), "running")
    totals = ranged.groupBy(part, group).agg(F.sum(out).alias("n"))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    offsets = totals.withColumn(before, F.sum("n").over(earlier)).where(F.col(before).isNotNull())
    offsets = F.broadcast(offsets.select(F.col(part).alias(p), F.col(group).alias(g), before))
    own = Window.partitionBy(part, group).orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn(out, F.sum(out).over(own))
    joined = local.join(offsets, (F.col(part) == F.col(p)) & F.col(group).eqNullSafe(F.col(g)), "left")
    return joined.select(*df.columns, (F.col(out) + F.coalesce(before, F.lit(0))).alias(out))


def text_pieces(df: DataFrame, group: str, order: list[str], text: Column, sep: str, size: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """The texts of a group joined by ``sep`` in order, as numbered pieces ``(group, piece, content)`` of
    about ``size`` characters: joined by ``sep`` in the order of their numbers (from 0, without holes)
    they are the whole text. A row is never cut, so a longer one makes a longer piece. Null texts are
    left out."""
    rows = df.select(group, *[c for c in order if c != group], text.alias("row_text")).where("row_text is not null")
    at = running_sum(rows, group, order, F.length("row_text") + len(sep), "end", partitions)
    start = F.col("end") - F.length("row_text") - len(sep)
    esc = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    by = ", ".join(f"`{c}`" for c in [*order, "end"])
    pieces = at.withColumn("slot", F.floor(start / size)).groupBy(group, "slot").agg(
        F.expr(f"listagg(row_text, '{esc}') WITHIN GROUP (ORDER BY {by})").alias("content"))
    # slots that a long row spans are empty; numbers have no holes
    numbered = running_sum(pieces, group, ["slot"], F.lit(1), "piece", partitions)
    return numbered.select(group, (F.col("piece") - 1).alias("piece"), "content")
