"""Knowledge-base build: text -> width-bounded chunks -> documents -> vectors.

Chunking is a native expression fold (no Python per row); embedding runs the caller's batch
model through Arrow batches, or an offline TF-IDF of sparse vectors (``sparse``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import wrap_chunks
from quarry.operators.sparse import tfidf_embed  # noqa: F401  the offline default model

CHUNK_WIDTH = 500  # fixed value: characters per chunk

CHUNK_SCHEMA = "title string, chunk_id int, content string, source string"


def chunk_text(c: Column, width: int = CHUNK_WIDTH) -> Column:
    """``array<string>`` of lines of at most ``width`` characters (CHK-1, CHK-3)."""
    return wrap_chunks(c, width)


def chunk_documents(df: DataFrame, text: str = "text", title: str | Column = "title",
                    source: str | Column = "source", width: int = CHUNK_WIDTH,
                    keep: list[str] | None = None) -> DataFrame:
    """One row per chunk with a 1-based ``chunk_id`` (CHK-2); ``keep`` columns ride along."""
    t = F.col(title) if isinstance(title, str) else title
    s = F.col(source) if isinstance(source, str) else source
    extra = [F.col(k) for k in (keep or [])]
    return (df.select(*extra, t.cast("string").alias("title"), s.cast("string").alias("source"),
                      F.posexplode(chunk_text(F.col(text), width)).alias("_pos", "content"))
            .select(*[F.col(k) for k in (keep or [])], "title", (F.col("_pos") + 1).cast("int").alias("chunk_id"),
                    "content", "source"))


def to_documents(chunks: DataFrame) -> DataFrame:
    """Chunk rows -> ``(page_content, metadata struct<title, chunk_id, source>)``; content is
    required, absent metadata becomes ``""`` (CHK-4)."""
    def meta(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in chunks.columns else F.lit("")

    content = F.when(F.col("content").isNotNull(), F.col("content")) \
        .otherwise(F.raise_error(F.lit("chunk without content")))
    extra = [c for c in chunks.columns if c not in ("title", "chunk_id", "source", "content")]
    return chunks.select(*extra, content.alias("page_content"),
                         F.struct(meta("title").alias("title"), meta("chunk_id").alias("chunk_id"),
                                  meta("source").alias("source")).alias("metadata"))


def embed_batches(df: DataFrame, text: str, fn: Callable[[list[str]], np.ndarray], dim: int,
                  out: str = "embedding") -> DataFrame:
    """Embed ``text`` with the caller's batch model (EMB-1): ``fn(list[str]) -> (n, dim)`` array.
    The model runs once per Arrow batch inside the executors; vectors are not normalised."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            vecs = np.asarray(fn(pdf[text].fillna("").tolist()), dtype=np.float32).reshape(len(pdf), dim)
            pdf[out] = pd.Series(list(vecs), index=pdf.index)
            yield pdf

    return df.mapInPandas(run, schema)
