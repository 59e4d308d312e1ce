"""Page extraction on literal HTML: block order, unclosed paragraphs, scripts holding a close tag,
link resolution."""

from pyspark.sql import functions as F

from quarry.functions.text import wrap_by_tokens
from quarry.operators import extract as X

HTML = ("<html><head><title>T</title><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>A</a></li><li><a href=\"http://x.org/b\">B</a></li><li><a href='//cdn.org/c'>C</a>"
        "</li><li><a href='d.html'>D</a></li><li><a href=''>empty</a></li><li><a href='/e'> </a></li></ul></nav>"
        "<article><p>First &amp; one<br>two</p><p>Second<p>  </p><ol><li>o1</li><li>o2</ol>"
        "<ul><li>u1<li>u2</li></ul><!-- <p>hidden</p> --></article></body></html>")


def test_blocks_paragraphs_links(spark):
    pages = spark.createDataFrame([(1, "https://site.org/dir/page?q=1", HTML)], "page_id long, url string, html string")
    b = X.extract_blocks(pages).first()
    assert list(b["blocks"]) == ["First & one\ntwo", "Second", "o1", "o2", "u1", "u2"]
    p = X.extract_paragraphs(pages).first()
    assert p["content"] == "First & one\ntwo\nSecond" and p["paragraphs"] == 2
    links = [(r["title"], r["link"]) for r in X.extract_links(pages).orderBy("pos").collect()]
    assert links == [("A", "https://site.org/a"), ("B", "http://x.org/b"), ("C", "https://cdn.org/c"),
                     ("D", "https://site.org/dir/d.html"), ("", "https://site.org/e")]
    assert X.extract_links(pages).select(X.host(F.col("url")).alias("h")).first()["h"] == "site.org"


def test_native_wrap_tabs(spark):
    import textwrap
    texts = ["a\tb\tc", "tab\there\tand\tthere " * 30, "\tlead", "x\t" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [list(r["w"]) for r in df.select(wrap_by_tokens(F.col("t"), 20).alias("w")).collect()]
    assert got == [textwrap.wrap(t, 20) for t in texts]


def test_container_nesting(spark):
    rows = [('<div class="text"><div>in</div><p>kept</p></div><p>out</p>', "<div>in</div><p>kept</p>"), ("<div>a</div>", ""),
            ('<div class="x text y">open <div>b', "open <div>b"), ("", ""), ('<div id="text">no</div><DIV CLASS="text">yes</DIV>', "yes")]
    df = spark.createDataFrame(rows, "h string, want string")
    got = df.select(X.container(F.col("h"), "div", r'class="[^"]*\btext\b').alias("c"), "want").collect()
    assert all(r["c"] == r["want"] for r in got)
    two = spark.createDataFrame([(1, "http://a.org/", "<p>x</p>"), (2, "http://b.org/", "<nav><a href='/q'></a></nav>")], "page_id long, url string, html string") \
        .withColumn("source", X.host(F.col("url")))
    rep = X.crawl_report(two, X.extract_links(two).withColumn("source", X.host(F.col("url"))), spark.createDataFrame([("b.org", 1)], "source string, total int"))
    assert {r["source"]: (r["pages"], r["links"], r["complete"]) for r in rep.collect()} == {"a.org": (1, 0, False), "b.org": (1, 1, True)}


def test_nested_lists(spark):
    """Every item of every list, nested ones with each list that holds them."""
    cases = {
        "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>": ["a\nb", "b", "c", "b"],
        # all paragraphs, then the items of all ol, then of all ul; items of one list in page order
        "<p>t</p><ol><li>1<UL class=x><li>x<li>y &amp; z</ul><li>2</ol><ul><li>last</li></ul>": ["t", "1\nx\ny & z", "x", "y & z", "2", "x", "y & z", "last"],
        "<ul><li>a<ol><li>b<ul><li>c</li></ul></li></ol></li></ul>": ["b\nc", "c", "a\nb\nc", "b\nc", "c", "c"],
        "<ul><li>a<ul><li>open": ["a\nopen", "open", "open"],
        "<ul><li>plain</li></ul><ul><li>two</li></ul>": ["plain", "two"],
    }
    df = spark.createDataFrame([(i, "u", f"<article>{h}</article>") for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: list(r["blocks"]) for r in X.extract_blocks(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    long = spark.createDataFrame([(1, "u", "<article><ul><li>" + "x " * 60000 + "</li></ul></article>")], "page_id long, url string, html string")
    assert len(X.extract_blocks(long).first()["blocks"][0]) == 119999
