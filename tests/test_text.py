"""Chunking and text helpers against the standard library / Python string rules."""

import random
import textwrap

from pyspark.sql import functions as F

from quarry.functions.text import normalise_text, standardise_values, unescape_entities, wrap_by_tokens, wrap_chunks

EDGE = ["", " ", "   leading blanks", "trailing   ", "x" * 1234, "a-b c--d e—f", "tab\there\tand\tthere",
        "line\nbreaks\r\nand\x0bvertical\x0cfeeds", "9-9-9-" * 120, "word " * 300, "é" * 501,
        "hyphen-ated-words-that-go-on " * 40]


def _wrapped(spark, texts, width, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r["i"]: list(r["w"]) for r in df.select("i", fn(F.col("t"), width).alias("w")).collect()}


def test_wrap_matches_stdlib_on_edges(spark):
    for width in (7, 20, 500):
        got = _wrapped(spark, EDGE, width, wrap_chunks)
        for i, t in enumerate(EDGE):
            assert got[i] == textwrap.wrap(t, width), (width, t[:40])


def test_wrap_matches_stdlib_on_random_text(spark):
    random.seed(3)
    hyphens = ["a", "bb", "ccc-dd", "e--f", "—", " ", "  ", "\n", "word.", "hyphen-ated", "é", "ß", "-", "x" * 30, "9-9", "y" * 55, "--", "p-" * 40]
    blanks = ["a", "bb", "word.", " ", "  ", "\n\n", "\t", "é", "x" * 30, "y" * 49, "z" * 50, "q" * 51, "r" * 130, "\x0b", "𝒳" * 7, " " * 60]
    texts = ["".join(random.choice(alpha) + random.choice(["", " "]) for _ in range(random.randint(0, 80)))
             for alpha in (hyphens, blanks) for _ in range(400)]
    for width, fn in ((50, wrap_chunks), (50, wrap_by_tokens), (2, wrap_chunks), (1, wrap_chunks)):
        got = _wrapped(spark, texts, width, fn)
        bad = [t for i, t in enumerate(texts) if got[i] != textwrap.wrap(t, width)]
        assert not bad, (width, fn.__name__, len(bad), bad[0], )


def test_character_references(spark):
    import html
    refs = ["a &amp; b &lt;c&gt; &quot;q&quot; &#39;x&#39; &nbsp;|", "&#8217;&hellip;&eacute;&#x1F600;&#x61;", "&amp;lt; once", "&nosuch; & &; &#; &#x; &", "&#150;&#128;&#0;&#55296;", "plain", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(refs)], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", unescape_entities(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(refs))] == [html.unescape(r) for r in refs]


def test_wrap_whole_documents(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("text", wrap_chunks(F.col("text"), 500).alias("w")).collect()
    assert all(list(r["w"]) == textwrap.wrap(r["text"], 500) for r in rows)
    assert all(len(c) <= 500 for r in rows for c in r["w"])


def _py_normalise(v):
    import re
    if v is None:
        return None
    out = re.sub(r"[^\w\s]", "", v.strip().lower())
    return None if out == "nan" else out


def test_normalise_and_standardise(spark):
    vals = ["  Hello, World! ", "- a", "NaN", "Yes", " y ", "TRUE", "0", "No!", "none", "null", "", "ok²½", "\tTab "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["n"] for r in df.select(normalise_text(F.col("v")).alias("n")).collect()]
    assert got == [_py_normalise(v) for v in vals]
    std = [r["s"] for r in df.select(standardise_values(normalise_text(F.col("v"))).alias("s")).collect()]
    mapping = {"yes": "yes", "y": "yes", "true": "yes", "1": "yes", "no": "no", "n": "no", "false": "no", "0": "no",
               "nan": None, "none": None, "null": None, "": None}
    assert std == [mapping.get(x, x) if x is not None else None for x in got]
