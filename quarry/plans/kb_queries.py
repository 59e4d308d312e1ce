"""Knowledge-base and retrieval queries: chunks of ``documents``, vectors of ``embeddings``,
questions of ``benchmark``.

Test relations: the vector row ``vec_id`` indexes the document with the same ``doc_id``; the
retrieval queries of the vector checks are the per-label centroids of ``embeddings``; prompt
checks pair a query with the conversation session of the same id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import chunk as K
from quarry.operators import conversation as cnv
from quarry.operators import retrieve as R
from quarry.operators.sparse import squared_norm
from quarry.plans.registry import Tables, query

WS = "[\\t\\n\\x0B\\f\\r ]"


def label_centroids(emb: DataFrame) -> DataFrame:
    """Mean vector per label: ``(qid, qvec array<double>)``."""
    ex = emb.select("label", F.posexplode("embedding").alias("i", "v"))
    c = ex.groupBy("label", "i").agg(F.avg("v").alias("v"))
    return c.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")) \
        .select(F.col("label").cast("bigint").alias("qid"), F.transform("s", lambda x: x["v"]).alias("qvec"))


def centroid_hits(t: Tables, k: int = R.FETCH_K) -> DataFrame:
    return R.knn(label_centroids(t.embeddings), t.embeddings, k=k)


def mmr_hits(t: Tables) -> DataFrame:
    emb = t.embeddings
    cands = centroid_hits(t).join(emb.select(F.col("vec_id").alias("vid"), "embedding"), "vid")
    return R.mmr(cands, label_centroids(emb))


CENT = """cent AS (SELECT CAST(label AS BIGINT) AS qid, list(v ORDER BY i) AS qv FROM (
  SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings) GROUP BY label, i) GROUP BY label),
dist AS (SELECT c.qid, e.vec_id, pow(list_distance(c.qv, CAST(e.embedding AS DOUBLE[])), 2) AS d FROM cent c, embeddings e),
cand AS (SELECT qid, vec_id, d, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rn FROM dist QUALIFY rn <= 20)"""


def _mmr_step(prev: str, name: str) -> str:
    return f"""{name} AS (SELECT qid, es, vs, qs, list_append(sel, list_position(sc, list_max(sc))) AS sel FROM (
  SELECT *, list_transform(generate_series(1, len(es)), lambda i: CASE WHEN list_contains(sel, i) THEN -1e300
    ELSE 0.25 * qs[i] - 0.75 * list_max(list_transform(sel, lambda j: list_cosine_similarity(es[i], es[j]))) END) AS sc
  FROM {prev}))"""


MMR_STEPS = f"""s0 AS (SELECT qid, es, vs, list_transform(es, lambda x: list_cosine_similarity(qv, x)) AS qs FROM c),
s1 AS (SELECT *, [list_position(qs, list_max(qs))] AS sel FROM s0),
{_mmr_step('s1', 's2')},
{_mmr_step('s2', 's3')},
{_mmr_step('s3', 's4')},
{_mmr_step('s4', 's5')},
{_mmr_step('s5', 's6')},
hits AS (SELECT qid, CAST(unnest(generate_series(1, len(sel))) AS INTEGER) AS mmr_rank,
  unnest(list_transform(sel, lambda i: vs[i])) AS vid FROM s6)"""

MMR = f"""{CENT},
c AS (SELECT k.qid, any_value(q.qv) AS qv, list(CAST(e.embedding AS DOUBLE[]) ORDER BY k.rn) AS es,
  list(k.vec_id ORDER BY k.rn) AS vs FROM cand k JOIN cent q USING (qid) JOIN embeddings e ON e.vec_id = k.vec_id GROUP BY k.qid),
{MMR_STEPS}"""


@query("knn_l2", f"""WITH {CENT}
SELECT qid, CAST(rn AS INTEGER) AS rank, vec_id AS vid, round(d, 6) AS distance FROM cand""")
def q_knn_l2(spark, sf_dir):
    h = centroid_hits(Tables(spark, sf_dir))
    return h.withColumn("distance", F.round("distance", 6))


@query("mmr_rerank", f"""WITH {MMR} SELECT qid, mmr_rank, vid FROM hits""")
def q_mmr_rerank(spark, sf_dir):
    return mmr_hits(Tables(spark, sf_dir))


@query("retrieve_with_metadata", f"""WITH {MMR}
SELECT h.qid, h.mmr_rank, d.text AS content, 'doc ' || d.doc_id AS title, 1 AS chunk_id, d.source
FROM hits h JOIN documents d ON d.doc_id = h.vid""")
def q_retrieve_with_metadata(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"),
                              F.concat(F.lit("doc "), "doc_id").alias("title"), F.lit(1).alias("chunk_id"), "source")
    corpus = t.embeddings.select("vec_id", "embedding").join(docs, "vec_id", "left")
    return R.retrieve(label_centroids(t.embeddings), corpus).where("content is not null")


STUFFED = f"""{MMR},
stuffed AS (SELECT h.qid, string_agg(d.text, chr(10) || chr(10) ORDER BY h.mmr_rank) AS context
  FROM hits h JOIN documents d ON d.doc_id = h.vid GROUP BY h.qid)"""


def stuffed(t: Tables) -> DataFrame:
    h = mmr_hits(t).join(t.documents.select(F.col("doc_id").alias("vid"), F.col("text").alias("content")), "vid")
    return R.stuff_context(h)


@query("stuffed_context", f"WITH {STUFFED} SELECT qid, context FROM stuffed")
def q_stuffed_context(spark, sf_dir):
    return stuffed(Tables(spark, sf_dir))


def _sql_template(history: str, context: str, inp: str) -> str:
    import re
    pieces = re.split(r"\{(chat_history|context|input)\}", R.TEMPLATE)
    slot = {"chat_history": history, "context": context, "input": inp}
    out = []
    for i, p in enumerate(pieces):
        if i % 2 == 0:
            if p:
                out.append("'" + p.replace("'", "''") + "'")
        else:
            out.append(f"coalesce({slot[p]}, '')")
    return " || ".join(out)


SESSION_PARTS = """msgs AS (SELECT conv_id AS session_id, turn AS pos,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type, text AS content FROM conversations),
lastq AS (SELECT session_id, max(pos) FILTER (WHERE type = 'human') AS qpos FROM msgs GROUP BY session_id),
sess AS (SELECT l.session_id, (SELECT content FROM msgs m WHERE m.session_id = l.session_id AND m.pos = l.qpos) AS question,
  (SELECT string_agg(type || ': ' || content, chr(10) ORDER BY pos) FROM msgs m
    WHERE m.session_id = l.session_id AND m.pos < l.qpos AND type IN ('human', 'ai')) AS history
  FROM lastq l WHERE l.qpos IS NOT NULL)"""


def sessions(t: Tables) -> DataFrame:
    """Per session: the latest human message (the question) and the rendered history before it."""
    m = cnv.messages_from_log(t.conversations)
    q = m.filter(F.col("type") == "human").groupBy("session_id").agg(
        F.max_by("content", "pos").alias("question"), F.max("pos").alias("qpos"))
    before = m.join(q.select("session_id", "qpos"), "session_id").filter(F.col("pos") < F.col("qpos"))
    hist = cnv.render_history(before)
    return q.join(hist, "session_id", "left").select("session_id", "question", "history")


@query("prompts", f"""WITH {STUFFED}, {SESSION_PARTS}
SELECT x.session_id, {_sql_template('x.history', 's.context', 'x.question')} AS prompt
FROM sess x JOIN stuffed s ON x.session_id % (SELECT count(*) FROM cent) = s.qid""")
def q_prompts(spark, sf_dir):
    """Every session that has a question; its context is that of one of the centroids in turn."""
    t = Tables(spark, sf_dir)
    context = stuffed(t)
    n = label_centroids(t.embeddings).count()
    s = sessions(t).withColumn("qid", F.pmod("session_id", F.lit(n))).join(context, "qid")
    return s.select("session_id", R.fill_template(chat_history=F.col("history"), context=F.col("context"),
                                           input=F.col("question")).alias("prompt"))


ORDER_DOC = ("'o_orderkey: ' || o_orderkey || chr(10) || 'o_custkey: ' || o_custkey || chr(10) || "
             "'o_orderstatus: ' || trim(o_orderstatus) || chr(10) || 'o_totalprice: ' || o_totalprice || chr(10) || "
             "'o_orderdate: ' || o_orderdate || chr(10) || 'o_orderpriority: ' || trim(o_orderpriority)")


@query("prompts_file_context", f"""WITH {SESSION_PARTS},
ctx AS (SELECT o_custkey, string_agg({ORDER_DOC}, chr(10) ORDER BY o_orderkey) AS context FROM orders GROUP BY o_custkey)
SELECT x.session_id, {_sql_template('x.history', 'c.context', 'x.question')} AS prompt
FROM sess x LEFT JOIN ctx c ON c.o_custkey = x.session_id""")
def q_prompts_file_context(spark, sf_dir):
    """File questions: session s uploaded the orders of customer s as a CSV; its rows become the
    context instead of retrieval."""
    from quarry.sources.files import table_context
    t = Tables(spark, sf_dir)
    o = t.orders
    ctx = table_context(o, "o_custkey", "o_orderkey", cols=o.columns).withColumnRenamed("o_custkey", "session_id")
    s = sessions(t).join(ctx, "session_id", "left")
    return s.select("session_id", R.fill_template(chat_history=F.col("history"), context=F.col("context"),
                                                  input=F.col("question")).alias("prompt"))


# ------------------------------------------------------------------------------------------
# Chunking

def kb_chunks(t: Tables, width: int = K.CHUNK_WIDTH) -> DataFrame:
    """Documents -> chunk rows (title = document id, source = its source label)."""
    d = t.documents
    return K.chunk_documents(d, "text", F.concat(F.lit("doc "), F.col("doc_id")), "source", width, keep=["doc_id"])


def chunk_sql(width: int = K.CHUNK_WIDTH) -> str:
    """``WITH`` list that ends with ``chunk(doc_id, source, chunk_id, content)``: the wrap position by
    position. ``mark`` has an ``h`` for each character after which a line may end (a word's last one, a
    hyphen between letters, both sides of a dash of hyphens). For texts without tabs, leading blanks
    and words longer than a line, as the driver tables have them."""
    letter = r"regexp_full_match({}, '[\pL\pM_]')".format
    at = "p[i + {}]".format
    return rf"""WITH RECURSIVE plain AS (
  SELECT doc_id, source, translate(text, chr(10) || chr(11) || chr(12) || chr(13), '    ') AS t FROM documents WHERE text IS NOT NULL),
place AS (SELECT doc_id, p, unnest(range(4, length(p) - 2)) AS i FROM (SELECT doc_id, '   ' || t || '   ' AS p FROM plain WHERE contains(t, '-'))),
dash AS (SELECT doc_id, i, length(regexp_extract(substr(p, i + 1), '^(-{{2,}})[\pL\pM\pN_]', 1)) AS n
         FROM place WHERE regexp_full_match({at(0)}, '[\pL\pM\pN_!"''&.,?]')),
stop AS (
  SELECT doc_id, i FROM place
  WHERE {at(0)} = '-' AND {letter(at(-1))} AND ({letter(at(-2))} OR ({at(-2)} = '-' AND {letter(at(-3))}))
    AND {letter(at(1))} AND ({letter(at(2))} OR ({at(2)} = '-' AND {letter(at(3))}))
  UNION SELECT doc_id, i FROM dash WHERE n > 0 UNION SELECT doc_id, i + n FROM dash WHERE n > 0),
hyphen AS (
  SELECT place.doc_id, string_agg(CASE WHEN {at(0)} = ' ' THEN ' ' WHEN stop.i IS NOT NULL OR p[place.i + 1] = ' ' THEN 'h' ELSE 'x' END, '' ORDER BY place.i) AS m
  FROM (SELECT doc_id, p, i FROM place) place LEFT JOIN stop ON stop.doc_id = place.doc_id AND stop.i = place.i GROUP BY 1),
mark AS (
  SELECT doc_id, source, t, coalesce(m, regexp_replace(regexp_replace(t, '[^ ]', 'x', 'g'), 'x( |$)', 'h\1', 'g')) AS m
  FROM plain LEFT JOIN hyphen USING (doc_id)),
line AS (
  SELECT doc_id, 0 AS chunk_id, 0 AS pos, '' AS content FROM mark
  UNION ALL
  SELECT doc_id, chunk_id + 1, start + n, substr(t, start + 1, n)
  FROM (SELECT *, CASE WHEN contains(seg, 'h') THEN length(seg) - strpos(reverse(seg), 'h') + 1 ELSE length(seg) END AS n
        FROM (SELECT doc_id, chunk_id, t, start, substr(m, start + 1, {width}) AS seg
              FROM (SELECT line.doc_id, chunk_id, t, m, pos + length(substr(m, pos + 1)) - length(ltrim(substr(m, pos + 1), ' ')) AS start
                    FROM line JOIN mark USING (doc_id))))
  WHERE length(seg) > 0),
chunk AS (SELECT doc_id, source, chunk_id, content FROM line JOIN plain USING (doc_id) WHERE chunk_id > 0)
""".replace("p[i + 0] = ' '", "p[place.i] = ' '")


def digests(chunks: DataFrame) -> DataFrame:
    """A text's chunks as one digest: order, breaks and characters."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda c: c["content"])
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).cast("bigint").alias("chars"),
                                        F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


DIGEST_SQL = """SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars,
  sha256(string_agg(content, chr(10) ORDER BY chunk_id)) AS digest FROM chunk GROUP BY doc_id"""


@query("kb_chunks", chunk_sql() + "SELECT doc_id, 'doc ' || doc_id AS title, chunk_id, content, source FROM chunk")
def q_kb_chunks(spark, sf_dir):
    return kb_chunks(Tables(spark, sf_dir))


@query("chunk_counts", chunk_sql() + "SELECT doc_id, count(*) AS chunks, CAST(max(length(content)) AS INTEGER) AS longest FROM chunk GROUP BY doc_id")
def q_chunk_counts(spark, sf_dir):
    c = kb_chunks(Tables(spark, sf_dir))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("content")).alias("longest"))


@query("chunk_conservation", f"""SELECT doc_id, CAST(length(regexp_replace(text, '{WS}', '', 'g')) AS BIGINT) AS chars
FROM documents WHERE length(regexp_replace(text, '{WS}', '', 'g')) > 0""")
def q_chunk_conservation(spark, sf_dir):
    """Chunking keeps every non-blank character (blank documents yield no chunk)."""
    c = kb_chunks(Tables(spark, sf_dir))
    return c.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("content", WS, ""))).cast("bigint").alias("chars"))


@query("documents_with_metadata", """SELECT text AS page_content, lang AS title,
  CAST(doc_id + 1 AS VARCHAR) AS chunk_id, '' AS source FROM documents""")
def q_documents_with_metadata(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    rows = d.select(F.col("lang").alias("title"), (F.col("doc_id") + 1).cast("int").alias("chunk_id"), F.col("text").alias("content"))
    d = K.to_documents(rows)
    return d.select("page_content", "metadata.title", "metadata.chunk_id", "metadata.source")


#: Terms of the offline vectors.
TERMS = 1 << 10


def tfidf_sql(rows: str) -> str:
    """``weight(vec_id, kind, term, w)`` of the texts in ``both(vec_id, kind, content)``."""
    return rf"""both_ AS ({rows}),
word AS (SELECT vec_id, kind, unnest(regexp_extract_all(lower(coalesce(content, '')), '[\pL\pM\pN_]+')) AS w FROM both_),
tf AS (SELECT vec_id, kind, CAST('0x' || md5(w)[1:7] AS BIGINT) % {TERMS} AS term, count(*) AS n FROM word GROUP BY 1, 2, 3),
idf AS (SELECT term, ln(((SELECT count(*) FROM both_) + 1.0) / (count(*) + 1.0)) AS idf FROM tf GROUP BY term),
weight AS (SELECT vec_id, kind, CAST(term AS INTEGER) AS term, n * idf AS w FROM tf JOIN idf USING (term) WHERE idf <> 0)"""


@query("tfidf_embed", chunk_sql() + "," + tfidf_sql("SELECT doc_id * 1048576 + chunk_id AS vec_id, 'c' AS kind, content FROM chunk") + """
SELECT doc_id, chunk_id, CAST(count(term) AS INTEGER) AS terms, coalesce(sum(w * w), 0.0) AS sq_norm, CAST(coalesce(sum(term), 0) AS BIGINT) AS term_sum
FROM chunk LEFT JOIN weight ON vec_id = doc_id * 1048576 + chunk_id GROUP BY 1, 2""")
def q_tfidf_embed(spark, sf_dir):
    e = K.tfidf_embed(kb_chunks(Tables(spark, sf_dir)), "content", num_features=TERMS)
    return e.select("doc_id", "chunk_id", F.size("embedding").alias("terms"), squared_norm(F.col("embedding")).alias("sq_norm"),
                    F.aggregate("embedding", F.lit(0).cast("bigint"), lambda a, x: a + x["term"]).alias("term_sum"))


RAG_SQL = chunk_sql() + "," + tfidf_sql("""SELECT doc_id * 1048576 + chunk_id AS vec_id, 'c' AS kind, content FROM chunk
  UNION ALL SELECT item_id, 'q', text FROM benchmark""") + f""",
norm AS (SELECT vec_id, kind, sqrt(sum(w * w)) AS l FROM weight GROUP BY 1, 2),
unit AS (SELECT vec_id, kind, term, w / l AS w FROM weight JOIN norm USING (vec_id, kind)),
score AS (SELECT q.vec_id AS qid, c.vec_id, round(fsum(q.w * c.w), 9) AS s FROM unit q JOIN unit c ON q.term = c.term AND q.kind = 'q' AND c.kind = 'c' GROUP BY 1, 2),
cand AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) AS rn FROM score QUALIFY rn <= {R.FETCH_K}),
dense AS (
  SELECT vec_id, kind, list_transform(range({TERMS}), lambda t: coalesce(m[CAST(t AS INTEGER)], 0.0)) AS e
  FROM (SELECT vec_id, kind, map_from_entries(list((term, w))) AS m FROM unit
        WHERE (kind = 'q' AND vec_id IN (SELECT qid FROM cand)) OR (kind = 'c' AND vec_id IN (SELECT vec_id FROM cand)) GROUP BY 1, 2)),
c AS (SELECT k.qid, any_value(q.e) AS qv, list(d.e ORDER BY k.rn) AS es, list(k.vec_id ORDER BY k.rn) AS vs
  FROM cand k JOIN dense d ON d.vec_id = k.vec_id AND d.kind = 'c' JOIN dense q ON q.vec_id = k.qid AND q.kind = 'q' GROUP BY k.qid),
{MMR_STEPS},
stuffed AS (SELECT qid, string_agg(content, chr(10) || chr(10) ORDER BY mmr_rank) AS context
  FROM hits JOIN chunk ON vid = doc_id * 1048576 + chunk_id GROUP BY qid)
SELECT qid, {_sql_template("''", 'context', 'text')} AS prompt FROM stuffed JOIN benchmark ON item_id = qid"""


@query("rag_prompts", RAG_SQL)
def q_rag_prompts(spark, sf_dir):
    """End to end: benchmark questions and document chunks share one TF-IDF space; each question
    gets its 20 nearest chunks, MMR keeps 6, their texts are stuffed into the prompt."""
    t = Tables(spark, sf_dir)
    # a chunk's number: its document's id and its place (a document has fewer than 2^20 chunks)
    chunks = kb_chunks(t).withColumn("vec_id", F.col("doc_id") * (1 << 20) + F.col("chunk_id"))
    qs = t.benchmark.select(F.col("item_id").alias("vec_id"), F.lit("q").alias("kind"), F.col("text").alias("content"))
    both = chunks.select("vec_id", F.lit("c").alias("kind"), "content", "title", "chunk_id", "source") \
        .unionByName(qs, allowMissingColumns=True)
    emb = K.tfidf_embed(both, "content", num_features=TERMS, normalise=True)  # counts and texts are written once there
    questions = emb.filter(F.col("kind") == "q").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"),
                                                        F.col("content").alias("question"))
    found = R.retrieve(questions.select("qid", "qvec"), emb.filter(F.col("kind") == "c"))
    ctx = R.stuff_context(found)
    return ctx.join(questions, "qid").select("qid", R.fill_template(chat_history=F.lit(""), context=F.col("context"),
                                                                    input=F.col("question")).alias("prompt"))


@query("answer_step", """SELECT item_id, CASE WHEN length(text) % 3 = 0 THEN 'No response' ELSE length(text) || ' characters' END AS answer
FROM benchmark""")
def q_answer_step(spark, sf_dir):
    """Answer step with a caller batch function (here: the question's length); the model gives
    no answer for lengths divisible by 3 -> fallback text."""
    b = Tables(spark, sf_dir).benchmark.select("item_id", "text")

    def model(prompts):
        return [None if len(p) % 3 == 0 else f"{len(p)} characters" for p in prompts]

    return R.answer(b, "text", model).select("item_id", "answer")


@query("chunk_counts_80", chunk_sql(80) + DIGEST_SQL)
def q_chunk_counts_80(spark, sf_dir):
    """Another width: lines of at most 80 characters, each as the standard library breaks it."""
    return digests(kb_chunks(Tables(spark, sf_dir), 80))


@query("embed_caller", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es
FROM documents""")
def q_embed_caller(spark, sf_dir):
    """A caller's batch model as the embedding (here: two counts), on whole documents."""
    def model(texts):
        import numpy as np
        return np.array([[len(t), t.count("e")] for t in texts])

    e = K.embed_batches(Tables(spark, sf_dir).documents.select("doc_id", "text"), "text", model, 2)
    return e.select("doc_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("es"))
