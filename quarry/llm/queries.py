"""Queries ``opN_<name>`` of the training-data operators over the driver tables, with oracle SQL
where SQL can express the result over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann_join, byte_cnn, chat_format, decontam, filter_audit, html_text, jaccard_join, license_scan, line_dedup, source_mix, spelling, token_codes, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Vocabulary file of the token-id queries (a file of the installed ``public_tokenizers``).
TOKENIZER = "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


@query
def op4_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_codes.write_codes(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_codes.read_documents(spark, path)


@query
def op8_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE["op8_benchmark_windows"] = r"""
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
widths AS (SELECT DISTINCT n FROM grams),
win AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, widths WHERE len(w) >= n)),
hits AS (SELECT win.doc_id, win.n, win.i, grams.item_id FROM win JOIN grams USING (n, g)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: Weights of the sources, repeating in their order.
SOURCE_WEIGHTS = (5, 2, 1)


@query
def op10_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"), lambda i: SOURCE_WEIGHTS[i % 3], share=1.5, max_repeats=2)


@query
def op2_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_paths(chat_format.conversations_as_trees(conv.unionByName(extra))))


ORACLE["op2_reply_tree_chat"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ':' || chr(10) || replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<')
                       || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

#: Rules of the url query, by host and path.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the label of the document that the page's url names (the number
    after the language): good if of quality and not toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = (table(spark, sf_dir, "labels").where("quality is not null and doc_id is not null")
              .groupBy("doc_id").agg((F.min("quality") * (1 - F.coalesce(F.max("toxic"), F.lit(0)))).alias("good")))
    named = F.regexp_extract(url_filter.path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})(?:[^0-9]|$)", 1)
    outcomes = (pages.select(url_filter.host_of(F.col("url")).alias("host"), F.when(named != "", named.cast("long")).alias("doc_id"))
                .join(labels, "doc_id").select("host", "good"))
    return url_filter.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op5_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def held_out(doc_id):
    """Documents whose labels are never learnt."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


#: A document of at least this score counts as of quality.
QUALITY_SCORE = 0.3


@query
def op6_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = byte_cnn.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), held_out=held_out)
    scored = byte_cnn.add_score(docs, model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_SCORE).cast("int").alias("predicted"))


@query
def op7_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann_join.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, 10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE["op7_block_matrix_neighbours"] = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, min(list_distance(q.e, c.e)) AS score FROM v q JOIN v c
      ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e) GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""


@query
def op9_block_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for each document: its lines, how many stay, which (numbers from 0)."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("kept").cast("long").alias("n_kept"), "kept")


#: Phrases of the license query and their labels.
LICENSE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@query
def op11_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), LICENSE_PHRASES)


def _license_sql() -> str:
    """Every block against every template, every place against every phrase."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    notices = ", ".join(f"('{t.label}', {listed(t.tokens)}, {t.need})" for t in license_scan.NOTICES)
    phrases = ", ".join(f"('{label}', {listed(text.split())})" for text, label in LICENSE_PHRASES.items())
    return rf"""
WITH low AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
notice(label, tokens, need) AS (VALUES {notices}),
phrase(label, words) AS (VALUES {phrases}),
block AS (SELECT r, list_distinct(w[s + 1:s + {2 * license_scan.STRIDE}]) AS b
          FROM (SELECT r, w, unnest(range(0, len(w), {license_scan.STRIDE})) AS s FROM low)),
met AS (SELECT r, label, o / len(tokens) AS share
        FROM (SELECT r, label, tokens, need, len(list_intersect(b, tokens)) AS o FROM block, notice) WHERE o >= need),
place AS (SELECT r, label, i - 1 AS p
          FROM (SELECT r, label, w, words, unnest(range(1, len(w) - len(words) + 2)) AS i FROM low, phrase WHERE len(w) >= len(words))
          WHERE w[i] = words[1] AND w[i:i + len(words) - 1] = words),
base AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS names
         FROM place GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS names, max(share) AS score
          FROM (SELECT r, label, share FROM met UNION ALL SELECT r, label, 1.0::DOUBLE FROM place) GROUP BY r)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base.names, '') AS base_labels,
       coalesce(every.names, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM low LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""


ORACLE["op11_license_blocks"] = _license_sql()


@query
def op12_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                              table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


ORACLE["op12_survival_words"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
mark AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
fail AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
         + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS m
  FROM doc LEFT JOIN mark USING (doc_id)),
letter AS (SELECT unnest(range(0, 5)) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, k AS step, CAST(1 << o[k] AS INT) AS f,
         CAST(coalesce(list_sum(list_transform(o[1:k - 1], lambda x: 1 << x)), 0) AS INT) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS k)),
counts AS (
  SELECT part, filter_order, step, f, count(*) FILTER (m & (before | f) = 0) AS kept, count(*) FILTER (m & before = 0 AND m & f <> 0) AS removed,
         count(*) FILTER (m & before <> 0 AND m & f <> 0) AS redundant, count(*) FILTER (m = f) AS unique_fails,
         count(*) FILTER (m & before = 0 AND m & f <> 0 AND good) AS good_lost, count(*) FILTER (m & before = 0 AND m & f <> 0 AND toxic) AS toxic_lost
  FROM fail, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counts
"""


@query
def op13_kd_tree_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE["op13_kd_tree_variants"] = r"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) AS x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
run AS (
  SELECT s, run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS s, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2),
code AS (SELECT run, n, hex(encode(s || ':' || run)) AS x FROM run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(x) / 2 AS BIGINT)),
           lambda i: CAST(16 * strpos('0123456789ABCDEF', x[2 * i + 1]) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 17 AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM code, crc),
voc AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc),
hole AS (SELECT word, n, i, word[1:i - 1] || '*' || word[i + 1:] AS p, word[1:i - 1] || word[i + 1:] AS q FROM cut),
near AS (
  SELECT a.word, b.word AS other, b.n FROM hole a JOIN hole b ON a.p = b.p AND a.word <> b.word
  UNION SELECT hole.word, voc.word, voc.n FROM hole JOIN voc ON hole.q = voc.word
  UNION SELECT voc.word, hole.word, hole.n FROM hole JOIN voc ON hole.q = voc.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS best_n FROM near GROUP BY 1),
known AS (
  SELECT voc.word, CASE WHEN best_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM voc LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS node FROM known UNION ALL SELECT chain.word, form FROM chain JOIN known ON known.word = node WHERE form IS NOT NULL),
root AS (SELECT chain.word, node AS root FROM chain JOIN known ON known.word = node WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM known JOIN root USING (word)
"""
