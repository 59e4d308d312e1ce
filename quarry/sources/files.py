"""Sources and sinks: CSV with encoding fallback, JSON lines, CSV export, payload codecs, rows and
pages as documents, vector tables, knowledge-base union."""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.running import text_pieces
from quarry.session import shared_dir
from quarry.types import col_of

# Text the CSV reader treats as missing (pandas' default NA tokens) and the
# encodings tried in order (latin-1 maps every byte, so it always succeeds).
CSV_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ENCODINGS = ("utf-8", "latin-1", "cp1252")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{shared_dir(spark, name)}/{uuid.uuid4().hex}"


def file_kinds(spark: SparkSession, path: str) -> DataFrame:
    """``(path, encoding, header)``: UTF-8 when every line of the file is valid UTF-8, else latin-1 (Spark's
    charset name ``ISO-8859-1``), and the bytes of the first line. Lines are checked where they are
    read; no file is one value."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                         "value", F.monotonically_increasing_id().alias("i"))
    first = F.min_by(F.when(F.col("block") == 0, F.col("value").cast("binary")), F.when(F.col("block") == 0, F.col("i")))
    return lines.groupBy("path").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"), first.alias("header"))


def header_names(line: str) -> list[str] | None:
    """Column names of a header line as a data-frame reader gives them: equal ones get ``.1``, ``.2``, empty
    ones ``Unnamed: <place>``; None where a quoted name goes on in the next line."""
    if line.count('"') % 2:
        return None
    fields = next(csv.reader([line.removeprefix("\ufeff")]), [])
    names: list[str] = []
    for i, f in enumerate(fields):
        name, k = f or f"Unnamed: {i}", 0
        while name in names:
            k += 1
            name = f"{f or f'Unnamed: {i}'}.{k}"
        names.append(name)
    return names


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns read as a data-frame reader does: missing-value tokens are null; a column of
    integers is ``bigint``, or ``decimal(38,0)`` where some are larger (``double`` if it has gaps), of
    numbers ``double``, of true/false ``boolean``, anything else (dates too) stays text. One aggregate
    decides for all columns."""
    df = df.select(*[F.when(~col_of(c).isin(*CSV_NA_TOKENS), col_of(c)).alias(c) for c in df.columns])
    number = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|Infinity|Inf)\s*$"
    parts = [F.struct(F.count(x).alias("n"), F.count_if(x.rlike(r"^\s*[+-]?\d{1,38}\s*$")).alias("i"),
                      F.count_if(x.rlike(r"^\s*[+-]?\d{1,19}\s*$") & F.trim(x).try_cast("bigint").isNotNull()).alias("l"), F.count_if(x.rlike(number)).alias("d"),
                      F.count_if(x.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias("b")).alias(f"c{k}")
             for k, x in enumerate(col_of(c) for c in df.columns)]
    if not parts:
        return df
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    out = []
    for k, c in enumerate(df.columns):
        s, x = seen[f"c{k}"], col_of(c)
        kind = ("string" if not s["n"] else "bigint" if s["l"] == s["n"] == seen["rows"]
                else "decimal(38,0)" if s["i"] == s["n"] == seen["rows"] else "double" if s["d"] == s["n"]
                else "boolean" if s["b"] == s["n"] else "string")
        out.append((x if kind == "string" else F.trim(x).try_cast(kind)).alias(c))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, encoding: str | None = None, schema=None) -> DataFrame:
    """Header CSV with inferred types (SRC-1): quoted fields may hold commas, doubled quotes and line
    breaks. Without ``encoding`` each file is checked: valid UTF-8 is read as UTF-8, anything else as
    latin-1. Files of a folder are matched by column name, whatever their order; a column that a file does
    not have is null there. Names follow ``header_names``. Missing-value tokens become null; ``schema``
    (columns in the files' order) replaces the inference."""
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("quote", '"')
              .option("escape", '"').option("inferSchema", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    charsets = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1"}
    groups: dict[tuple, list[str]] = {}
    for r in file_kinds(spark, path).collect():  # one row per file
        charset = r["encoding"] if encoding is None else charsets.get(encoding.lower(), encoding)
        groups.setdefault((charset, bytes(r["header"] or b"")), []).append(r["path"])
    frames = []
    for (charset, header), paths in sorted(groups.items()):
        names = header_names(header.decode(charset, "replace"))
        one = reader.option("encoding", charset)
        if schema is not None or names:
            one = one.schema(schema if schema is not None else T.StructType([T.StructField(c, T.StringType()) for c in names]))
        frames.append(one.csv(sorted(paths)))
    if not frames:
        return (reader if schema is None else reader.schema(schema)).csv(path)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return infer_types(out) if schema is None else out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Cleaned table export: header CSV, no index column, quotes doubled inside fields (SRC-4)."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


CHUNK_JSON_SCHEMA = "title string, chunk_id int, content string, source string"


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_JSON_SCHEMA, strict: bool = True) -> DataFrame:
    """JSON lines (SRC-2). ``strict``: any bad line fails the load (the reference returns an
    empty list instead; we raise). Otherwise bad lines land in ``_corrupt_record``."""
    r = spark.read.schema(schema if strict else schema + ", _corrupt_record string")
    return r.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def append_jsonl(df: DataFrame, path: str) -> str:
    """Append chunk rows as JSON lines (SRC-3)."""
    df.write.mode("append").json(path)
    return path


def encode_payload(c: Column) -> Column:
    """Bytes or text -> one-line base64 text (SRC-5). Spark's ``base64`` may wrap lines every 76
    characters (``spark.sql.chunkBase64String.enabled``); the payload format has no breaks."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def decode_payload(c: Column) -> Column:
    """base64 text -> bytes (SRC-5)."""
    return F.unbase64(c)


def plain_text(c: Column, kind: T.DataType) -> Column:
    """A value as text; doubles as plain decimals (``12345678.9``, not ``1.23456789E7``) where
    Python writes them so."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast("string")
    digits = F.regexp_replace(c.cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), plain).otherwise(c.cast("string"))


def row_document(df: DataFrame, cols: list[str] | None = None) -> Column:
    """One ``column: value`` line per column (both trimmed), newline-joined (SRC-6)."""
    cols = cols or df.columns
    return F.concat_ws("\n", *[F.concat(F.lit(c.strip() + ": "), F.coalesce(F.trim(plain_text(col_of(c), df.schema[c].dataType)), F.lit("")))
                               for c in cols])


def rows_to_documents(df: DataFrame, cols: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each row as a document (SRC-6)."""
    return df.select(*(keep or []), row_document(df, cols).alias("page_content"))


def table_context(df: DataFrame, file_key: str, order_by: str, cols: list[str] | None = None) -> DataFrame:
    """All row documents of a file joined by newlines, in row order (SRC-6): ``(file_key, context)``."""
    cols = cols or [c for c in df.columns if c != file_key]
    docs = df.select(file_key, order_by, row_document(df, cols).alias("_doc"))
    return docs.groupBy(file_key).agg(F.expr(f"listagg(_doc, '\\n') WITHIN GROUP (ORDER BY {order_by})").alias("context"))


def pages_context(df: DataFrame, file_key: str, page_no: str, text: str) -> DataFrame:
    """Page texts of a file joined by newlines, in page order (SRC-7)."""
    return df.groupBy(file_key).agg(F.expr(f"listagg({text}, '\\n') WITHIN GROUP (ORDER BY {page_no})").alias("context"))


def table_context_pieces(df: DataFrame, file_key: str, order_by: str, cols: list[str] | None = None, size: int = 1 << 20) -> DataFrame:
    """``table_context`` as numbered pieces of about ``size`` characters (``text_pieces``), for files of any
    number of rows: ``(file_key, piece, content)``."""
    cols = cols or [c for c in df.columns if c != file_key]
    return text_pieces(df, file_key, [order_by], row_document(df, cols), "\n", size)


def pages_context_pieces(df: DataFrame, file_key: str, page_no: str, text: str, size: int = 1 << 20) -> DataFrame:
    """``pages_context`` as numbered pieces, for files of any number of pages."""
    return text_pieces(df, file_key, [page_no], col_of(text), "\n", size)


def save_vectors(df: DataFrame, path: str, mode: str = "append") -> str:
    """Persist a vector table as parquet (SRC-8); append by default, overwrite when asked."""
    df.write.mode(mode).parquet(path)
    return path


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_sources(*dfs: DataFrame, dedup: bool = False) -> DataFrame:
    """Knowledge base over several sources (SRC-9); reruns repeat chunks unless ``dedup``."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.dropDuplicates(["source", "title", "chunk_id", "content"]) if dedup else out


