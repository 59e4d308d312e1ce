"""Source and sink round trips; every write goes to a fresh folder under the shared checkpoint
folder and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.page_queries import PARAS, HOST
from quarry.plans.registry import Tables, query
from quarry.operators import extract as X
from quarry.sources import files as SRC

DOC_CHUNKS = """bc AS (SELECT lang AS title, CAST(doc_id + 1 AS INTEGER) AS chunk_id, text AS content,
  'docs.example.org' AS source FROM documents)"""


def doc_chunks(t: Tables, source: str = "docs.example.org") -> DataFrame:
    return t.documents.select(F.col("lang").alias("title"), (F.col("doc_id") + 1).cast("int").alias("chunk_id"),
                              F.col("text").alias("content"), F.lit(source).alias("source"))


@query("csv_roundtrip", "SELECT * FROM customer")
def q_csv_roundtrip(spark, sf_dir):
    """Export a table as header CSV, read it back with inferred types and encoding detection."""
    src = Tables(spark, sf_dir).customer
    path = SRC.write_csv(src, SRC.scratch_path(spark, "csv"))
    back = SRC.read_table(spark, path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in src.schema.fields])


@query("jsonl_roundtrip", f"WITH {DOC_CHUNKS} SELECT * FROM bc")
def q_jsonl_roundtrip(spark, sf_dir):
    path = SRC.append_jsonl(doc_chunks(Tables(spark, sf_dir)), SRC.scratch_path(spark, "jsonl"))
    return SRC.read_jsonl(spark, path, strict=True)


@query("payload_roundtrip", "SELECT doc_id, base64(encode(text)) AS payload, text AS decoded FROM documents")
def q_payload_roundtrip(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    enc = d.select("doc_id", SRC.encode_payload(F.col("text")).alias("payload"))
    return enc.select("doc_id", "payload", SRC.decode_payload(F.col("payload")).cast("string").alias("decoded"))


CUST_DOC = ("'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || trim(c_name) || chr(10) || "
            "'c_nationkey: ' || c_nationkey || chr(10) || 'c_acctbal: ' || c_acctbal || chr(10) || "
            "'c_mktsegment: ' || trim(c_mktsegment)")


@query("rows_as_documents", f"SELECT c_custkey, {CUST_DOC} AS page_content FROM customer")
def q_rows_as_documents(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return SRC.rows_to_documents(c, keep=["c_custkey"])


@query("table_context", f"""SELECT c_nationkey, string_agg({CUST_DOC}, chr(10) ORDER BY c_custkey) AS context
FROM customer GROUP BY c_nationkey""")
def q_table_context(spark, sf_dir):
    """Customers of one nation form one uploaded file; its rows in key order are the context."""
    c = Tables(spark, sf_dir).customer
    return SRC.table_context(c, "c_nationkey", "c_custkey", cols=c.columns)


@query("pages_context", f"""WITH {PARAS}
SELECT regexp_extract(url, '{HOST}', 1) AS source, string_agg(array_to_string(ps, chr(10)), chr(10) ORDER BY page_id) AS context
FROM p GROUP BY 1""")
def q_pages_context(spark, sf_dir):
    """The pages of one site form one paged file; page texts in page order are the context."""
    a = X.extract_paragraphs(Tables(spark, sf_dir).pages).withColumn("source", X.host(F.col("url")))
    return SRC.pages_context(a, "source", "page_id", "content")


@query("vector_roundtrip", """SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS sq_norm FROM embeddings""")
def q_vector_roundtrip(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    path = SRC.save_vectors(e, SRC.scratch_path(spark, "vectors"))
    back = SRC.load_vectors(spark, path)
    return back.select("vec_id", "label", F.size("embedding").alias("dims"),
                       F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 6)
                       .alias("sq_norm"))


@query("kb_union", f"""WITH {DOC_CHUNKS}
SELECT * FROM bc UNION ALL SELECT title, chunk_id, content, 'mirror.example.org' FROM bc UNION ALL SELECT * FROM bc""")
def q_kb_union(spark, sf_dir):
    """Two sources plus a rerun of the first: the knowledge base repeats the rerun's chunks."""
    t = Tables(spark, sf_dir)
    a, b = doc_chunks(t), doc_chunks(t, "mirror.example.org")
    return SRC.union_sources(a, b, a)


@query("kb_union_dedup", f"""WITH {DOC_CHUNKS}
SELECT * FROM bc UNION SELECT title, chunk_id, content, 'mirror.example.org' FROM bc""")
def q_kb_union_dedup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = doc_chunks(t), doc_chunks(t, "mirror.example.org")
    return SRC.union_sources(a, b, a, dedup=True)


@query("csv_dirty_roundtrip", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS qty,
  'He said "' || p_name || '", ' || chr(10) || 'é ok' AS note, '2024-01-0' || (p_partkey % 9 + 1) AS day FROM part""")
def q_csv_dirty_roundtrip(spark, sf_dir):
    """Missing-value tokens in a number column, doubled quotes, commas and line breaks in quoted
    fields, dates (kept as text), one UTF-8 and one latin-1 file."""
    p = Tables(spark, sf_dir).part
    k = F.col("p_partkey")
    d = p.select("p_partkey", F.when(k % 4 == 0, "NA").otherwise(F.col("p_size").cast("string")).alias("qty"),
                 F.concat(F.lit('He said "'), "p_name", F.lit('", \né ok')).alias("note"), F.concat(F.lit("2024-01-0"), (k % 9 + 1).cast("string")).alias("day"))
    path = SRC.write_csv(d.where("p_partkey % 2 = 0").coalesce(1), SRC.scratch_path(spark, "csv"))
    d.where("p_partkey % 2 = 1").coalesce(1).write.mode("append").option("header", True).option("quote", '"').option("escape", '"') \
        .option("encoding", "ISO-8859-1").csv(path)
    return SRC.read_table(spark, path)


@query("csv_swapped_columns", """SELECT c_custkey, c_name, c_acctbal, 9223372036854775807 - c_custkey AS large,
  CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def q_csv_swapped_columns(spark, sf_dir):
    """Two files of one encoding, with other column orders, one column more in the second, and
    19-digit integers."""
    c = Tables(spark, sf_dir).customer.withColumn("large", F.lit((1 << 63) - 1) - F.col("c_custkey"))
    path = SRC.write_csv(c.where("c_custkey % 2 = 0").select("c_name", "large", "c_custkey", "c_acctbal").coalesce(1), SRC.scratch_path(spark, "csv"))
    SRC.write_csv(c.where("c_custkey % 2 = 1").select("c_custkey", "c_mktsegment", "c_acctbal", "large", "c_name").coalesce(1), path, "append")
    return SRC.read_table(spark, path).select("c_custkey", "c_name", "c_acctbal", "large", "c_mktsegment")
