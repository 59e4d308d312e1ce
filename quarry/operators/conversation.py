"""Conversation log jobs: message store, histories, titles, uploads, cache, upload limiter.

The store is a table ``(session_id, pos, type, content, file)``; ``file`` is
``struct<type, name, format, base64>`` or null. ``type`` is ``human`` / ``ai`` (other roles are
kept but never rendered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.running import text_pieces
from quarry.functions.text import WHITESPACE, let
from quarry.operators.limiter import UPLOAD_LIMIT, drop_repeats, limit_step, micros, rate_limit  # noqa: F401  part of this module's interface
from quarry.session import stored

FILE_TYPE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("format", T.StringType()), T.StructField("base64", T.StringType())])

# Default session, fallback answers, error prefixes.
DEFAULT_SESSION = "default"
NO_RESPONSE = "No response"
API_ERROR_PREFIX = "❌ API Error: "
UNEXPECTED_ERROR_PREFIX = "❌ Unexpected Error: "
NO_ANSWER = "⚠️ No answer returned."


def messages_from_log(df: DataFrame, session: str = "conv_id", pos: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """Map a raw log (role user/assistant/system) to the store schema."""
    typ = F.when(F.col(role) == "user", "human").when(F.col(role) == "assistant", "ai").otherwise(F.col(role))
    return df.select(F.col(session).alias("session_id"), F.col(pos).cast("bigint").alias("pos"),
                     typ.alias("type"), F.col(text).alias("content"),
                     F.lit(None).cast(FILE_TYPE).alias("file"))


def session_key(c: Column) -> Column:
    """Missing or empty session id -> ``default`` (CNV-8)."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(DEFAULT_SESSION))


def append_history(store: DataFrame, batch: DataFrame, dedup: bool = False) -> DataFrame:
    """Append a submitted history to the store (CNV-1, CNV-3).

    ``batch`` positions are the client's 0-based positions. Default: the reference behaviour --
    every submitted message is appended after the session's last stored position (the client
    resends old turns, so they repeat). ``dedup=True`` keeps only positions not yet stored."""
    cols = ["session_id", "pos", "type", "content", "file"]
    if dedup:
        return store.select(cols).unionByName(
            batch.select(cols).join(store.select("session_id", "pos"), ["session_id", "pos"], "left_anti"))
    offset = store.groupBy("session_id").agg((F.max("pos") + 1).alias("offset"))
    moved = (batch.join(offset, "session_id", "left")
             .withColumn("pos", F.coalesce("offset", F.lit(0)) + F.col("pos"))
             .select(cols))
    return store.select(cols).unionByName(moved)


def append_answers(store: DataFrame, answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Add one ``ai`` message per session at the end (CNV-3); missing answer -> ``No response``."""
    batch = answers.select(
        "session_id", F.lit(0).cast("bigint").alias("pos"), F.lit("ai").alias("type"),
        F.coalesce(F.col(answer), F.lit(NO_RESPONSE)).alias("content"),
        F.lit(None).cast(FILE_TYPE).alias("file"))
    return append_history(store, batch)


def render_history(store: DataFrame) -> DataFrame:
    """``(session_id, history)``: ``type: content`` lines in position order, human/ai only (CNV-2)."""
    return (store.filter(F.col("type").isin("human", "ai"))
            .groupBy("session_id")
            .agg(F.expr("listagg(concat(type, ': ', content), '\\n') WITHIN GROUP (ORDER BY pos)")
                 .alias("history")))


def render_history_pieces(store: DataFrame, size: int = 1 << 20) -> DataFrame:
    """``render_history`` as numbered pieces of about ``size`` characters, for sessions of any length:
    ``(session_id, piece, content)``."""
    line = F.concat(F.col("type"), F.lit(": "), F.col("content"))
    return text_pieces(store.filter(F.col("type").isin("human", "ai")), "session_id", ["pos"], line, "\n", size)


def attach_file(store: DataFrame, uploads: DataFrame) -> DataFrame:
    """Put the session's current upload on every human message (CNV-4). ``uploads`` is
    ``(session_id, file)``, one row per session."""
    u = uploads.select("session_id", F.col("file").alias("_upload"))
    j = store.join(u, "session_id", "left")
    return j.withColumn("file", F.when((F.col("type") == "human") & F.col("_upload").isNotNull(),
                                       F.col("_upload")).otherwise(F.col("file"))).drop("_upload")


def session_history(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Full history per requested id as rows ``(session_id, pos, type, content)`` (CNV-5); an
    unknown id yields one row with null message fields (an empty history). Rows, not one array
    per session: a session of any size is never gathered into one value."""
    return ids.select("session_id").distinct().join(store.select("session_id", "pos", "type", "content"),
                                                    "session_id", "left")


def session_titles(store: DataFrame, width: int | None = None) -> DataFrame:
    """First human message of each session; sessions without one are left out (CNV-6)."""
    t = store.filter(F.col("type") == "human").groupBy("session_id") \
        .agg(F.min_by("content", "pos").alias("title"))
    return t.withColumn("title", F.substring("title", 1, width)) if width else t


def display_history(store: DataFrame) -> DataFrame:
    """UI projection (CNV-7): ai/human only, an image attachment surfaces as image/type; a store with
    the older ``image`` and ``image_type`` columns shows those where there is no attachment."""
    is_img = (F.col("type") == "human") & F.col("file").isNotNull() & (F.col("file.type") == "image")

    def shown(new: str, old: str) -> Column:  # older messages hold the image in fields of their own
        was = F.when(F.col("type") == "human", F.col(old)) if old in store.columns else F.lit(None)
        return F.coalesce(F.when(is_img, F.col(new)), was).alias(old)

    return (store.filter(F.col("type").isin("human", "ai"))
            .select("session_id", "pos", "type", "content", shown("file.base64", "image"), shown("file.format", "image_type")))


def serialise(store: DataFrame) -> DataFrame:
    """Send projection: type and content only, as JSON text (CNV-9)."""
    return store.select("session_id", "pos", F.to_json(F.struct("type", "content")).alias("payload"))


def route(requests: DataFrame) -> DataFrame:
    """Endpoint per request: csv (data and name) > image > pdf (data and name) > chat (CNV-10)."""
    def given(c: str) -> Column:  # an empty string is no upload
        return F.nullif(F.col(c), F.lit("")).isNotNull()

    r = (F.when(given("csv_base64") & given("csv_filename"), "csv-upload")
         .when(given("image_base64"), "image-upload")
         .when(given("pdf_base64") & given("pdf_filename"), "pdf-upload")
         .otherwise("chat"))
    return requests.withColumn("route", r)


def content_key(requests: DataFrame) -> DataFrame:
    """sha-256 of the payload (image) or payload + question (csv, pdf); null for chat (CNV-11)."""
    r = F.col("route")
    key = (F.when(r == "image-upload", F.sha2(F.col("image_base64"), 256))
           .when(r == "csv-upload", F.sha2(F.concat("csv_base64", "question"), 256))
           .when(r == "pdf-upload", F.sha2(F.concat("pdf_base64", "question"), 256)))
    return requests.withColumn("content_key", key)


def cache_split(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known keys -> stored context (hits); unknown keys -> one row per key to compute (misses)
    (CNV-12). Requests without a key are neither. A key stored twice counts with its smaller context."""
    keyed = requests.filter(F.col("content_key").isNotNull())
    c = cache.groupBy("content_key").agg(F.min("context").alias("context"))
    hits = keyed.join(c, "content_key", "inner")
    misses = keyed.join(c, "content_key", "left_anti").select("content_key").distinct()
    return hits, misses


def cache_merge(cache: DataFrame, computed: DataFrame, order: str | None = None) -> DataFrame:
    """Add newly computed contexts; a stored context of a key wins, then the first computed in
    ``order`` (without it, the smallest text)."""
    new = computed.join(cache.select("content_key"), "content_key", "left_anti")
    first = F.min_by("context", order) if order else F.min("context")
    return cache.groupBy("content_key").agg(F.min("context").alias("context")).unionByName(
        new.groupBy("content_key").agg(first.alias("context")))


# A CSV record up to its line break: quoted fields may hold breaks. Possessive, so that no step is kept.
_RECORD = r"""(?s)\G((?:[^"\r\n]++|"(?:[^"]++|"")*+"?)++)(?:\r\n|\n|\r|\z)|\G(?:\r\n|\n|\r)"""
NOT_BASE64 = "not base64 text"


def csv_context(requests: DataFrame, payload: str = "csv_base64", key: str = "content_key") -> DataFrame:
    """``(content_key, context, error)`` of uploaded CSV payloads (CNV-12, compute step): base64 text of a
    header CSV -> its rows as documents, ``column: value`` lines, newline-joined. Bytes that are not UTF-8
    are read as latin-1, as files are. A payload that is not base64 has an empty context and an
    ``error``; it fails its row, not the job. Equal keys are computed once.

    Records are cut by one pattern and parsed by Spark's own CSV function; a payload is one value of its
    row."""
    once = requests.filter(F.col(key).isNotNull() & F.col(payload).isNotNull()).groupBy(key).agg(F.min(payload).alias("p"))
    raw = F.try_to_binary("p", F.lit("base64"))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    records = F.filter(F.regexp_extract_all(F.col("text"), F.lit(_RECORD), 1), lambda r: r != "")
    cut = once.select(key, text.alias("text")).select(key, F.col("text").isNull().alias("bad"), records.alias("records"))
    cut = stored(cut, "payloads")
    width = cut.agg(F.max(_fields_of(F.get("records", F.lit(0))))).first()[0] or 1  # of the widest header
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {"quote": '"', "escape": '"', "maxColumns": str(width + 1), "mode": "PERMISSIVE", "multiLine": "true",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

    def fields(record: Column) -> Column:
        """A record's fields, as many as it has (up to the widest header); empty ones are ''."""
        return let(F.from_csv(record, schema, options), lambda r: F.slice(
            F.array(*[F.coalesce(F.btrim(r[f"c{i}"], F.lit(WHITESPACE)), F.lit("")) for i in range(width)]), F.lit(1), F.least(F.lit(width), _fields_of(record))))

    def lines(head: Column) -> Column:
        def of(record: Column) -> Column:
            pairs = F.zip_with(head, fields(record), lambda c, v: F.concat(c, F.lit(": "), v))  # the shorter one ends both
            return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "\n")

        return F.array_join(F.transform(F.slice("records", 2, 1 << 30), of), "\n")

    context = F.when(F.size("records") > 0, let(fields(F.get("records", F.lit(0))), lines)).otherwise(F.lit(""))
    return cut.select(key, context.alias("context"), F.when(F.col("bad"), F.lit(NOT_BASE64)).alias("error"))


def _fields_of(record: Column) -> Column:
    """How many fields a CSV record has: commas outside quotes, and one."""
    return F.regexp_count(F.regexp_replace(record, r'(?s)"(?:[^"]++|"")*+"?', ""), F.lit(",")) + 1


def first_payloads(store: DataFrame) -> DataFrame:
    """Each distinct attachment once per session, at its first position (CNV-13):
    ``(session_id, pos, payload_md5)``. An aggregate (min position) rather than a window, so a
    session with a third of all rows is combined map-side."""
    h = store.filter(F.col("file.base64").isNotNull()) \
        .withColumn("payload_md5", F.md5(F.unbase64(F.col("file.base64"))))
    return h.groupBy("session_id", "payload_md5").agg(F.min("pos").alias("pos")) \
        .select("session_id", "pos", "payload_md5")


def error_to_message(df: DataFrame, error: str = "error", answer: str = "answer", unexpected: str | None = None,
                     no_answer: str = NO_RESPONSE) -> Column:
    """What a call leaves in the history as the ai message (CNV-17): a failed request its error, any other
    failure (column ``unexpected``) that, a missing answer ``no_answer`` (the service says
    ``No response``, the app ``NO_ANSWER``), else the answer."""
    shown = F.when(F.col(error).isNotNull(), F.concat(F.lit(API_ERROR_PREFIX), F.col(error)))
    if unexpected:
        shown = shown.when(F.col(unexpected).isNotNull(), F.concat(F.lit(UNEXPECTED_ERROR_PREFIX), F.col(unexpected)))
    return shown.otherwise(F.coalesce(F.col(answer), F.lit(no_answer)))
