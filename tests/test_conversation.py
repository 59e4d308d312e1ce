"""Conversation store operations on literal rows: append with/without dedup, attachments only on
human turns, cache merge keeps the stored context, routing priority."""

from pyspark.sql import functions as F

from quarry.operators import conversation as cnv

STORE = "session_id string, pos bigint, type string, content string, file struct<type:string,name:string,format:string,base64:string>"


def test_append_attach_cache_route(spark):
    store = spark.createDataFrame([("s", 0, "human", "hi", None), ("s", 1, "ai", "hello", None)], STORE)
    batch = spark.createDataFrame([("s", 0, "human", "hi", None), ("s", 1, "ai", "hello", None),
                                   ("s", 2, "human", "more", None), ("t", 0, "human", "new", None)], STORE)
    grown = cnv.append_history(store, batch).orderBy("session_id", "pos").collect()
    assert [(r["session_id"], r["pos"], r["content"]) for r in grown] == [
        ("s", 0, "hi"), ("s", 1, "hello"), ("s", 2, "hi"), ("s", 3, "hello"), ("s", 4, "more"), ("t", 0, "new")]
    dedup = cnv.append_history(store, batch, dedup=True).orderBy("session_id", "pos").collect()
    assert [(r["session_id"], r["pos"]) for r in dedup] == [("s", 0), ("s", 1), ("s", 2), ("t", 0)]
    up = spark.createDataFrame([("s", ("image", "x.png", "image/png", "eA=="))], "session_id string, file " + STORE.split("file ")[1])
    att = {r["pos"]: r["file"] for r in cnv.attach_file(store, up).collect()}
    assert att[0]["name"] == "x.png" and att[1] is None
    cache = spark.createDataFrame([("k1", "old")], "content_key string, context string")
    new = spark.createDataFrame([("k1", "new"), ("k2", "two")], "content_key string, context string")
    assert {r["content_key"]: r["context"] for r in cnv.cache_merge(cache, new).collect()} == {"k1": "old", "k2": "two"}
    req = spark.createDataFrame([("a", "n", "i", None, None), (None, None, "i", "p", "f"), ("a", None, None, "p", "f"),
                                 (None, None, None, None, None), ("", "f", "", "", "f")],
                                "csv_base64 string, csv_filename string, image_base64 string, pdf_base64 string, pdf_filename string")
    assert [r["route"] for r in cnv.route(req).collect()] == ["csv-upload", "image-upload", "pdf-upload", "chat", "chat"]


def test_csv_context_and_repeats(spark):
    import base64
    import datetime as dt
    raw = base64.b64encode("a, b\n1,\"x, \"\"y\"\"\"\n2, é \n".encode()).decode()
    req = spark.createDataFrame([("k", raw), ("k", raw), (None, raw)], "content_key string, csv_base64 string")
    assert [r["context"] for r in cnv.csv_context(req).collect()] == ['a: 1\nb: x, "y"\na: 2\nb: é']
    t = dt.datetime(2024, 1, 1)
    ev = [(i, "u", t + dt.timedelta(minutes=i), n) for i, n in enumerate("abcdd")] + [(9, "u", t + dt.timedelta(hours=7), "d")]
    df = spark.createDataFrame(ev, "event_id long, k string, ts timestamp_ntz, name string")
    got = {r["event_id"]: r["is_new"] for r in cnv.drop_repeats(df, "k", "ts", "name", "event_id").collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True}  # d was refused before, so it is new at last


def test_display_older_image_fields(spark):
    old = spark.createDataFrame([("s", 0, "human", "hi", None, "QQ==", "png"), ("s", 1, "ai", "yo", None, "QQ==", "png")], STORE + ", image string, image_type string")
    assert [(r["image"], r["image_type"]) for r in cnv.display_history(old).orderBy("pos").collect()] == [("QQ==", "png"), (None, None)]


def test_payloads_as_the_csv_reader_reads_them(spark):
    """Quotes, breaks, short and long rows, blank lines, other encodings, bad payloads, very long records."""
    import base64
    import csv
    import io
    import random
    r = random.Random(4)
    csv.field_size_limit(1 << 30)
    cell = lambda: r.choice(["", "x", "two words", '"q, ""u"""', '"line\nbreak"', "é", " pad ", "1.5"])
    texts = ["", "\n\n", "only,header", "a,b\n\n1,2\r\n3\n4,5,6", 'a\n"' + 'long ""q"" ' * 20000 + '"\n' + "x" * 200000]
    texts += [r.choice(["\n", "\r\n"]).join(",".join(cell() for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))) for _ in range(60)]
    rows = [(str(i), base64.b64encode(t.encode()).decode()) for i, t in enumerate(texts)]
    rows += [("latin", base64.b64encode("k\ncafé".encode("latin-1")).decode()), ("bad", "*no*"), ("bad2", "QQ=x")]
    got = {x["content_key"]: (x["context"], x["error"]) for x in cnv.csv_context(spark.createDataFrame(rows, "content_key string, csv_base64 string")).collect()}

    def want(text):
        lines = [x for x in csv.reader(io.StringIO(text, newline="")) if x]
        head = lines[0] if lines else []
        return "\n".join(f"{c.strip()}: {v.strip()}" for x in lines[1:] for c, v in zip(head, x))

    for i, t in enumerate(texts):
        assert got[str(i)] == (want(t), None), (i, t[:200])
    assert got["latin"] == ("k: café", None) and got["bad"] == ("", cnv.NOT_BASE64) == got["bad2"]
