"""Conversation-log queries over ``conversations`` (the message log) and ``events`` (requests and
uploads). Test mapping: conv_id = session, turn = position, user = human, assistant = ai."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import conversation as cnv
from quarry.plans.registry import Tables, query
from quarry.sources.files import encode_payload

# --- shared inputs -------------------------------------------------------------------------
MSGS = """msgs AS (SELECT conv_id AS session_id, turn AS pos,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type,
  text AS content FROM conversations)"""

# Latest upload of each user (events as upload attempts, event_type as the file name).
UPLOADS = """uploads AS (SELECT user_id AS session_id, arg_max(event_type, event_id) AS name
  FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
  GROUP BY user_id)"""

# Requests derived from events: the event type decides which payload fields are present.
REQUESTS = """requests AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS session_id, ts,
  props AS question,
  CASE WHEN event_type IN ('click', 'error') THEN base64(encode(event_type)) END AS image_base64,
  CASE WHEN event_type IN ('click', 'error') THEN 'image/png' END AS image_type,
  CASE WHEN event_type IN ('purchase', 'error') THEN base64(encode(event_type || ':' || props)) END AS csv_base64,
  CASE WHEN event_type = 'purchase' THEN event_type || '.csv' END AS csv_filename,
  CASE WHEN event_type = 'view' THEN base64(encode(props)) END AS pdf_base64,
  CASE WHEN event_type = 'view' THEN event_type || '.pdf' END AS pdf_filename
  FROM events)"""

ROUTED = """routed AS (SELECT *, CASE
  WHEN csv_base64 IS NOT NULL AND csv_filename IS NOT NULL THEN 'csv-upload'
  WHEN image_base64 IS NOT NULL THEN 'image-upload'
  WHEN pdf_base64 IS NOT NULL AND pdf_filename IS NOT NULL THEN 'pdf-upload'
  ELSE 'chat' END AS route FROM requests)"""

KEYED = """keyed AS (SELECT *, CASE route
  WHEN 'image-upload' THEN sha256(image_base64)
  WHEN 'csv-upload' THEN sha256(csv_base64 || question)
  WHEN 'pdf-upload' THEN sha256(pdf_base64 || question) END AS content_key FROM routed)"""

# Contexts computed by earlier traffic (first day, before 2024-01-02) form the cache.
CACHE = """cache AS (SELECT content_key, 'context of ' || min(route) AS context FROM keyed
  WHERE content_key IS NOT NULL AND ts < TIMESTAMP '2024-01-02' GROUP BY content_key)"""


def messages(t: Tables) -> DataFrame:
    return cnv.messages_from_log(t.conversations)


def uploads(t: Tables) -> DataFrame:
    e = t.events
    latest = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("name"))
    return latest.select(
        F.col("user_id").alias("session_id"),
        F.struct(F.lit("image").alias("type"), F.col("name").alias("name"),
                 F.lit("image/png").alias("format"), encode_payload(F.col("name")).alias("base64")).alias("file"))


def requests(t: Tables) -> DataFrame:
    e = t.events
    et = F.col("event_type")
    img = et.isin("click", "error")
    return e.select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("session_id"), "ts",
        F.col("props").alias("question"),
        F.when(img, encode_payload(et)).alias("image_base64"),
        F.when(img, F.lit("image/png")).alias("image_type"),
        F.when(et.isin("purchase", "error"), encode_payload(F.concat(et, F.lit(":"), F.col("props")))).alias("csv_base64"),
        F.when(et == "purchase", F.concat(et, F.lit(".csv"))).alias("csv_filename"),
        F.when(et == "view", encode_payload(F.col("props"))).alias("pdf_base64"),
        F.when(et == "view", F.concat(et, F.lit(".pdf"))).alias("pdf_filename"))


def keyed_requests(t: Tables) -> DataFrame:
    return cnv.content_key(cnv.route(requests(t)))


def cache_table(t: Tables) -> DataFrame:
    k = keyed_requests(t)
    return (k.filter(F.col("content_key").isNotNull() & (F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")))
            .groupBy("content_key").agg(F.concat(F.lit("context of "), F.min("route")).alias("context")))


# --- queries -------------------------------------------------------------------------------
@query("session_titles", f"""WITH {MSGS}
SELECT session_id, substr(arg_min(content, pos), 1, 40) AS title FROM msgs WHERE type = 'human'
GROUP BY session_id""")
def q_session_titles(spark, sf_dir):
    return cnv.session_titles(messages(Tables(spark, sf_dir)), width=40)


#: Characters of a history's pieces in the query.
PIECE = 600


@query("history_pieces", f"""WITH {MSGS},
line AS (SELECT session_id, pos, type || ': ' || content AS t FROM msgs WHERE type IN ('human', 'ai')),
slot AS (SELECT *, (sum(length(t) + 1) OVER (PARTITION BY session_id ORDER BY pos) - length(t) - 1) // {PIECE} AS slot FROM line),
piece AS (SELECT session_id, slot, string_agg(t, chr(10) ORDER BY pos) AS content FROM slot WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY slot) - 1 AS piece, content FROM piece""")
def q_history_pieces(spark, sf_dir):
    return cnv.render_history_pieces(messages(Tables(spark, sf_dir)), PIECE)


@query("render_history", f"""WITH {MSGS}
SELECT session_id, string_agg(type || ': ' || content, chr(10) ORDER BY pos) AS history
FROM msgs WHERE type IN ('human', 'ai') GROUP BY session_id""")
def q_render_history(spark, sf_dir):
    return cnv.render_history(messages(Tables(spark, sf_dir)))


@query("history_append", f"""WITH {MSGS},
off AS (SELECT session_id, max(pos) + 1 AS o FROM msgs GROUP BY session_id)
SELECT session_id, pos, type, content FROM msgs
UNION ALL
SELECT m.session_id, m.pos + off.o AS pos, m.type, m.content FROM msgs m JOIN off USING (session_id)
UNION ALL
SELECT session_id, a.pos, 'ai' AS type, 'No response' AS content FROM
  (SELECT session_id, 2 * max(pos) + 2 AS pos FROM msgs GROUP BY session_id) a""")
def q_history_append(spark, sf_dir):
    """The client resends its whole history (every stored turn repeats), then the answer -- a
    null answer, so the fallback text -- is appended at the end of each session."""
    m = messages(Tables(spark, sf_dir))
    grown = cnv.append_history(m, m)
    answers = m.select("session_id").distinct().withColumn("answer", F.lit(None).cast("string"))
    return cnv.append_answers(grown, answers).select("session_id", "pos", "type", "content")


@query("history_append_dedup", f"""WITH {MSGS}
SELECT session_id, pos, type, content FROM msgs""")
def q_history_append_dedup(spark, sf_dir):
    """The store holds the even turns; the client resends the whole history, so the odd turns are
    added and the even ones are not repeated."""
    m = messages(Tables(spark, sf_dir))
    return cnv.append_history(m.filter(F.col("pos") % 2 == 0), m, dedup=True).select("session_id", "pos", "type", "content")


@query("csv_payload_context", """SELECT sha256(base64(encode('event, kind' || chr(10) || event_id || ',' || event_type || chr(10) || '7,"a, b"')) || props) AS content_key,
  'event: ' || event_id || chr(10) || 'kind: ' || event_type || chr(10) || 'event: 7' || chr(10) || 'kind: a, b' AS context FROM events""")
def q_csv_payload_context(spark, sf_dir):
    """Every request uploads a CSV made from its event; all keys are unknown, so all are computed."""
    e = Tables(spark, sf_dir).events
    csv = F.concat(F.lit("event, kind\n"), "event_id", F.lit(","), "event_type", F.lit('\n7,"a, b"'))
    r = e.select(encode_payload(csv).alias("csv_base64"), F.col("props").alias("question"), F.lit("csv-upload").alias("route"),
                 F.lit(None).cast("string").alias("image_base64"), F.lit(None).cast("string").alias("pdf_base64"))
    return cnv.csv_context(cnv.content_key(r)).select("content_key", "context")


@query("csv_payload_errors", """SELECT sha256(CASE event_id % 3 WHEN 0 THEN '*' || event_id || '*' WHEN 1 THEN base64(encode('kind' || chr(10) || event_id))
                ELSE 'a2luZApjYWbp' END) AS content_key,
       any_value(CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'kind: ' || event_id ELSE 'kind: café' END) AS context,
       any_value(CASE event_id % 3 WHEN 0 THEN 'not base64 text' END) AS error
FROM events GROUP BY 1""")
def q_csv_payload_errors(spark, sf_dir):
    """Uploads of all events: a third is not base64, a third is latin-1, a third is sound."""
    e, k = Tables(spark, sf_dir).events, F.col("event_id") % 3
    sound = encode_payload(F.concat(F.lit("kind\n"), F.col("event_id")))
    p = F.when(k == 0, F.concat(F.lit("*"), F.col("event_id"), F.lit("*"))).when(k == 1, sound).otherwise(F.lit("a2luZApjYWbp"))
    return cnv.csv_context(e.select(p.alias("csv_base64"), F.sha2(p, 256).alias("content_key")))


@query("answer_messages", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '❌ API Error: timeout' WHEN 1 THEN '❌ Unexpected Error: ' || event_type
  WHEN 2 THEN '⚠️ No answer returned.' ELSE props END AS message FROM events""")
def q_answer_messages(spark, sf_dir):
    """What the app shows for each kind of outcome: failed request, other failure, no answer, answer."""
    e, k = Tables(spark, sf_dir).events, F.col("event_id") % 4
    r = e.select("event_id", F.when(k == 0, "timeout").alias("error"), F.when(k == 1, F.col("event_type")).alias("failure"), F.when(k == 3, F.col("props")).alias("answer"))
    return r.select("event_id", cnv.error_to_message(r, unexpected="failure", no_answer=cnv.NO_ANSWER).alias("message"))


@query("attach_file", f"""WITH {MSGS}, {UPLOADS}
SELECT m.session_id, m.pos, m.type, m.content,
  CASE WHEN m.type = 'human' AND u.name IS NOT NULL THEN 'image' END AS file_type,
  CASE WHEN m.type = 'human' THEN u.name END AS file_name,
  CASE WHEN m.type = 'human' AND u.name IS NOT NULL THEN base64(encode(u.name)) END AS file_base64
FROM msgs m LEFT JOIN uploads u USING (session_id)""")
def q_attach_file(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = cnv.attach_file(messages(t), uploads(t))
    return a.select("session_id", "pos", "type", "content", F.col("file.type").alias("file_type"),
                    F.col("file.name").alias("file_name"), F.col("file.base64").alias("file_base64"))


@query("display_history", f"""WITH {MSGS}, {UPLOADS}
SELECT m.session_id, m.pos, m.type, m.content,
  CASE WHEN m.type = 'human' AND u.name IS NOT NULL THEN base64(encode(u.name)) END AS image,
  CASE WHEN m.type = 'human' AND u.name IS NOT NULL THEN 'image/png' END AS image_type
FROM msgs m LEFT JOIN uploads u USING (session_id) WHERE m.type IN ('human', 'ai')""")
def q_display_history(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return cnv.display_history(cnv.attach_file(messages(t), uploads(t)))


@query("first_payloads", f"""WITH {MSGS}, {UPLOADS},
att AS (SELECT m.session_id, m.pos, md5(from_base64(base64(encode(u.name)))) AS payload_md5
  FROM msgs m JOIN uploads u USING (session_id) WHERE m.type = 'human')
SELECT session_id, min(pos) AS pos, payload_md5 FROM att GROUP BY session_id, payload_md5""")
def q_first_payloads(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return cnv.first_payloads(cnv.attach_file(messages(t), uploads(t)))


@query("session_history", f"""WITH {MSGS},
ids AS (SELECT DISTINCT user_id AS session_id FROM events)
SELECT ids.session_id, m.pos, m.type, m.content FROM ids LEFT JOIN msgs m USING (session_id)""")
def q_session_history(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ids = t.events.select(F.col("user_id").alias("session_id"))
    return cnv.session_history(messages(t), ids)


@query("session_key", """SELECT event_id,
  coalesce(nullif(CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 10 = 1 THEN ''
                       ELSE CAST(user_id AS VARCHAR) END, ''), 'default') AS session_key
FROM events""")
def q_session_key(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    raw = (F.when(F.col("user_id") % 10 == 0, F.lit(None).cast("string"))
           .when(F.col("user_id") % 10 == 1, F.lit("")).otherwise(F.col("user_id").cast("string")))
    return e.select("event_id", cnv.session_key(raw).alias("session_key"))


@query("serialised_history", f"""WITH {MSGS}
SELECT session_id, pos, to_json(struct_pack(type := type, content := content))::VARCHAR AS payload FROM msgs""")
def q_serialised_history(spark, sf_dir):
    return cnv.serialise(messages(Tables(spark, sf_dir)))


@query("route_requests", f"""WITH {REQUESTS}, {ROUTED}
SELECT request_id, session_id, route FROM routed""")
def q_route_requests(spark, sf_dir):
    return cnv.route(requests(Tables(spark, sf_dir))).select("request_id", "session_id", "route")


@query("content_keys", f"""WITH {REQUESTS}, {ROUTED}, {KEYED}
SELECT request_id, route, content_key FROM keyed""")
def q_content_keys(spark, sf_dir):
    return keyed_requests(Tables(spark, sf_dir)).select("request_id", "route", "content_key")


@query("cache_hits", f"""WITH {REQUESTS}, {ROUTED}, {KEYED}, {CACHE}
SELECT k.request_id, k.content_key, c.context FROM keyed k JOIN cache c USING (content_key)
WHERE k.ts >= TIMESTAMP '2024-01-02'""")
def q_cache_hits(spark, sf_dir):
    t = Tables(spark, sf_dir)
    later = keyed_requests(t).filter(F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz"))
    hits, _ = cnv.cache_split(later, cache_table(t))
    return hits.select("request_id", "content_key", "context")


@query("cache_misses", f"""WITH {REQUESTS}, {ROUTED}, {KEYED}, {CACHE}
SELECT DISTINCT k.content_key FROM keyed k WHERE k.ts >= TIMESTAMP '2024-01-02'
AND k.content_key IS NOT NULL AND k.content_key NOT IN (SELECT content_key FROM cache)""")
def q_cache_misses(spark, sf_dir):
    t = Tables(spark, sf_dir)
    later = keyed_requests(t).filter(F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz"))
    _, misses = cnv.cache_split(later, cache_table(t))
    return misses


@query("cache_merge", f"""WITH {REQUESTS}, {ROUTED}, {KEYED}, {CACHE}
SELECT content_key, context FROM cache
UNION ALL
SELECT DISTINCT content_key, 'context of ' || route AS context FROM keyed
WHERE content_key IS NOT NULL AND content_key NOT IN (SELECT content_key FROM cache)""")
def q_cache_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = keyed_requests(t).filter(F.col("content_key").isNotNull())
    computed = k.select("content_key", F.concat(F.lit("context of "), F.col("route")).alias("context"))
    return cnv.cache_merge(cache_table(t), computed)


LIMIT_SQL = """WITH RECURSIVE ev AS (
  SELECT user_id, event_id, ts, event_type AS name,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT user_id, rn, event_id, [ts] AS kept, name AS last, 'accepted' AS status FROM ev WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, event_id,
    CASE WHEN len(k0) >= 3 OR name = last THEN k0 ELSE list_append(k0, ts) END AS kept,
    CASE WHEN len(k0) >= 3 OR name = last THEN last ELSE name END AS last,
    CASE WHEN len(k0) >= 3 THEN 'refused' WHEN name = last THEN 'repeat' ELSE 'accepted' END AS status
  FROM (SELECT e.user_id, e.rn, e.event_id, e.ts, e.name, r.last,
               list_filter(r.kept, lambda x: x > e.ts - INTERVAL 6 HOUR) AS k0
        FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1) s)
"""


@query("rate_limit", LIMIT_SQL + """SELECT event_id, user_id, status,
  CAST(greatest(0, 3 - len(kept)) AS INTEGER) AS uploads_left FROM r""")
def q_rate_limit(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    out = cnv.rate_limit(e.select("event_id", "user_id", "ts", "event_type"), key="user_id", ts="ts",
                         name="event_type", event_id="event_id")
    return out.select("event_id", "user_id", "status", "uploads_left")


@query("uploads_left", LIMIT_SQL + """SELECT user_id,
  CAST(count(*) FILTER (WHERE status = 'accepted') AS BIGINT) AS accepted,
  CAST(count(*) FILTER (WHERE status = 'refused') AS BIGINT) AS refused,
  CAST(count(*) FILTER (WHERE status = 'repeat') AS BIGINT) AS repeats,
  CAST(arg_max(greatest(0, 3 - len(kept)), rn) AS INTEGER) AS uploads_left FROM r GROUP BY user_id""")
def q_uploads_left(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    out = cnv.rate_limit(e.select("event_id", "user_id", "ts", "event_type"), key="user_id", ts="ts",
                         name="event_type", event_id="event_id")
    st = F.col("status")
    return out.groupBy("user_id").agg(
        F.count(F.when(st == "accepted", 1)).alias("accepted"),
        F.count(F.when(st == "refused", 1)).alias("refused"),
        F.count(F.when(st == "repeat", 1)).alias("repeats"),
        F.max_by("uploads_left", F.struct("ts", "event_id")).alias("uploads_left"))


@query("drop_repeats", LIMIT_SQL + "SELECT event_id, user_id, status = 'accepted' AS is_new FROM r")
def q_drop_repeats(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return cnv.drop_repeats(e, "user_id", "ts", "event_type", "event_id").select("event_id", "user_id", "is_new")


@query("answer_default", f"""WITH {REQUESTS}, {ROUTED}
SELECT request_id, CASE WHEN route = 'chat' THEN '❌ API Error: ' || 'timeout'
  WHEN route = 'pdf-upload' THEN 'No response' ELSE 'answer to ' || question END AS answer FROM routed""")
def q_answer_default(spark, sf_dir):
    """Answer step result handling: chat requests fail (error text becomes the ai message), pdf
    requests get no answer (fallback text), others get the model's answer."""
    r = cnv.route(requests(Tables(spark, sf_dir)))
    r = r.withColumn("error", F.when(F.col("route") == "chat", F.lit("timeout"))) \
         .withColumn("answer", F.when(F.col("route") != "pdf-upload", F.concat(F.lit("answer to "), F.col("question"))))
    return r.select("request_id", cnv.error_to_message(r).alias("answer"))
