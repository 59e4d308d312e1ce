"""Page extraction over a ``pages(page_id, url, html)`` table: links, paragraphs, blocks,
result totals, crawl report, status handling, source labels and per-source page caps.

Everything is regex extraction on whole pages, partition-parallel, with no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.running import running_sum
from quarry.functions.text import let, unescape_entities

# Page limits, error prefix, the "Showing a – b of N" pattern.
MAX_LISTING_PAGES = 10
ERROR_PREFIX = "Error: "
TOTAL_PATTERN = r"Showing\s+\d+\s*–\s*\d+\s+of\s+(\d+)"

_NOISE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
_ANCHOR = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def strip_noise(html: Column) -> Column:
    """Drop scripts, styles and comments (a script may hold a ``</p>``)."""
    return F.regexp_replace(html, _NOISE, " ")


def container(html: Column, tag: str = "article", attribute: str | None = None) -> Column:
    """Inner HTML of the first ``<tag>`` element (with ``attribute``, a regular expression, in its
    opening tag; e.g. ``class="[^"]*\\btext\\b``), up to its own closing tag however deep equal
    elements are nested; up to the end of the document if it is not closed; empty when absent."""
    opening = rf"(?is)<{tag}\b" + (f"(?=[^>]*?{attribute})" if attribute else "") + r"[^>]*>"

    def inner(rest: Column) -> Column:
        before = F.element_at(F.split(rest, rf"(?i)</{tag}\b", 2), 1)
        nested = before.rlike(rf"(?i)<{tag}\b")  # only then equal elements are counted
        return F.when(nested, _to_own_close(rest, tag)).otherwise(before)

    return let(F.split(strip_noise(html), opening, 2), lambda parts: F.when(F.size(parts) < 2, "").otherwise(let(F.get(parts, F.lit(1)), inner)))


def _to_own_close(rest: Column, tag: str) -> Column:
    """``rest`` up to the closing tag that matches an element opened before it."""
    def cut(pieces: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            d = a["depth"] + F.when(p.rlike(rf"(?i)^</{tag}\b"), -1).when(p.rlike(rf"(?i)^<{tag}\b"), 1).otherwise(0)
            return F.struct((a["i"] + 1).alias("i"), d.alias("depth"), F.coalesce(a["stop"], F.when(d == 0, a["i"])).alias("stop"))

        at = F.aggregate(pieces, F.struct(F.lit(0).alias("i"), F.lit(1).alias("depth"), F.lit(None).cast("int").alias("stop")), step)
        return F.array_join(F.slice(pieces, F.lit(1), F.coalesce(at["stop"], F.size(pieces))), "")

    return let(F.split(rest, rf"(?i)(?=</?{tag}\b)"), cut)


def visible_text(fragment: Column) -> Column:
    """Rendered text of a fragment: ``<br>`` is a line break, other tags vanish, entities are
    decoded, runs of blanks collapse, lines are trimmed."""
    def plain(t: Column) -> Column:
        t = F.regexp_replace(t, r"[ \t\r\f\x0B\u00A0]+", " ")
        t = F.regexp_replace(t, r" *\n *", "\n")
        return F.regexp_replace(F.regexp_replace(t, r"^[\s]+", ""), r"[\s]+$", "")

    tagged = F.regexp_replace(F.regexp_replace(fragment, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
    return plain(unescape_entities(F.when(F.instr(fragment, "<") > 0, tagged).otherwise(fragment)))


def _items(fragment: Column, tag: str) -> Column:
    """Texts of ``<tag>`` elements; an element ends at its close tag or where the next starts."""
    return F.regexp_extract_all(fragment, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)(?=</{tag}>|<{tag}\b|$)"), 1)


def resolve_link(url: Column, href: Column) -> Column:
    """Absolute link of ``href`` on page ``url`` (what a browser reports)."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    base = F.when(base == "", F.concat(origin, F.lit("/"))).otherwise(base)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(base, href)))


def extract_links(pages: DataFrame, within: str = "nav") -> DataFrame:
    """Title + link pairs of a listing (EXT-1): ``(page_id, url, pos, title, link)``; anchors with an
    empty link are skipped, anchors without text keep an empty title."""
    frag = container(F.col("html"), within)
    z = F.arrays_zip(F.regexp_extract_all(frag, F.lit(_ANCHOR), 1).alias("href"),
                     F.regexp_extract_all(frag, F.lit(_ANCHOR), 2).alias("text"))
    e = pages.select("page_id", "url", F.posexplode(z).alias("pos", "a"))
    out = e.select("page_id", "url", F.col("pos").cast("int").alias("pos"), visible_text(F.col("a.text")).alias("title"),
                   F.trim(F.col("a.href")).alias("href"))
    return out.filter(F.col("href") != "").select("page_id", "url", "pos", "title", resolve_link(F.col("url"), F.col("href")).alias("link"))


def dedup_links(links: DataFrame, order: tuple[str, ...] = ("page_id", "pos")) -> DataFrame:
    """First-seen link wins across listing pages (EXT-2): ``min_by`` per link, an aggregate with
    map-side combining (a link repeated on a third of all pages is never one task's group)."""
    rest = [c for c in links.columns if c != "link"]
    first = links.groupBy("link").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(*[F.col(f"_f.{c}").alias(c) for c in rest], "link").select(*links.columns)


def paragraphs(pages: DataFrame, fragment: Column) -> DataFrame:
    """Paragraph texts of an HTML fragment of each page, blanks dropped, newline-joined."""
    paras = F.transform(_items(fragment, "p"), visible_text)
    kept = F.filter(paras, lambda s: F.length(F.trim(s)) > 0)
    return pages.select("page_id", "url", F.array_join(kept, "\n").alias("content"), F.size(kept).alias("paragraphs"))


def extract_paragraphs(pages: DataFrame, within: str = "article", attribute: str | None = None) -> DataFrame:
    """Article text (EXT-3): paragraph texts of the container, blanks dropped, newline-joined."""
    return paragraphs(pages, container(F.col("html"), within, attribute))


def extract_blocks(pages: DataFrame, within: str = "article", tags: tuple[str, ...] = ("p", "ol", "ul")) -> DataFrame:
    """Block texts in tag order -- every ``p``, then ``ol`` items, then ``ul`` items -- trimmed,
    blanks dropped (EXT-4); ``content`` is their space-joined text, ``blocks`` the array."""
    def blocks_of(frag: Column) -> Column:
        opened = F.array_join(F.regexp_extract_all(frag, F.lit(r"(?i)</?(?:ul|ol)\b"), 0), "")
        nested = opened.rlike("(?i)<[uo]l<[uo]l")  # a list begins before the one before it has ended
        flat, deep = [], []
        for t in tags:
            if t in ("ol", "ul"):
                lists = F.regexp_extract_all(frag, F.lit(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), 1)
                flat.append(F.flatten(F.transform(lists, lambda b: _items(b, "li"))))
                deep.append(_nested_items(frag, t))
            else:
                flat.append(_items(frag, t))
                deep.append(_items(frag, t))
        texts = F.when(nested, F.concat(*deep)).otherwise(F.concat(*flat))
        return F.filter(F.transform(texts, visible_text), lambda s: F.length(s) > 0)

    blocks = let(container(F.col("html"), within), blocks_of)
    return pages.select("page_id", "url", blocks.alias("blocks")).withColumn("content", F.array_join("blocks", " "))


def _nested_items(frag: Column, tag: str) -> Column:
    """Fragments of every ``li`` of every ``<tag>`` list, in document order; an item of a nested list comes with
    each list that holds it, and within its outer items. An item ends at its close, at the next item of
    its list, or with the list. Inner lists and items begin on new lines."""
    def items(p: Column) -> Column:
        kind = F.transform(p, lambda x: F.lower(F.regexp_extract(x, r"(?i)^<(/?(?:li|ul|ol))\b", 1)))

        def listed(k: Column) -> Column:
            step = F.transform(k, lambda x: F.when(x.isin("ul", "ol"), 1).when(x.isin("/ul", "/ol"), -1).otherwise(0))
            depth = F.aggregate(step, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)) + x)))
            rows = F.transform(p, lambda x, i: F.struct(i.alias("i"), F.get(k, i).alias("k")))
            return let(depth, lambda d: spans(rows, d))

        def spans(rows: Column, d: Column) -> Column:
            def stop(at: Column, ends) -> Column:  # the first row behind ``at`` that ends what it opens
                return F.coalesce(F.array_min(F.transform(F.filter(rows, lambda r: (r["i"] > at) & ends(r)), lambda r: r["i"])), F.size(rows))

            def own(li: Column) -> Column:
                level = F.get(d, li["i"])
                end = stop(li["i"], lambda r: (F.get(d, r["i"]) < level) | ((F.get(d, r["i"]) == level) & r["k"].isin("li", "/li")))
                text = F.array_join(F.slice(p, li["i"] + 1, end - li["i"]), "")
                return F.regexp_replace(F.regexp_replace(text, r"(?is)^<li\b[^>]*>", ""), r"(?is)(?:\s*</?(?:ul|ol|li)\b[^>]*>\s*)+", "\n")

            def of_list(open_: Column) -> Column:
                end = stop(open_["i"], lambda r: F.get(d, r["i"]) < F.get(d, open_["i"]))
                return F.transform(F.filter(rows, lambda r: (r["k"] == "li") & (r["i"] > open_["i"]) & (r["i"] < end)), own)

            return F.flatten(F.transform(F.filter(rows, lambda r: r["k"] == tag), of_list))

        return let(kind, listed)

    return let(F.split(frag, r"(?i)(?=</?(?:li|ul|ol)\b)"), items)


def parse_total(text: Column) -> Column:
    """N of ``Showing a – b of N``; 0 when absent (EXT-5)."""
    return F.coalesce(F.nullif(F.regexp_extract(text, TOTAL_PATTERN, 1), F.lit("")).try_cast("int"), F.lit(0))


def host(url: Column) -> Column:
    """Source label of a page: its host name (EXT-8)."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)", 1)


def crawl_report(pages: DataFrame, links: DataFrame, totals: DataFrame) -> DataFrame:
    """Per source of ``pages(page_id, source)``: listing pages, links seen, unique links, announced
    total, and whether the crawl is complete (unique links >= total) (EXT-6). Sources without links
    are reported with none."""
    base = pages.groupBy("source").agg(F.count_distinct("page_id").alias("pages"))
    per = links.groupBy("source").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("link").alias("unique_links"))
    out = base.join(per, "source", "left").join(totals, "source", "left")
    out = out.select("source", "pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("links", "unique_links", "total")])
    return out.withColumn("complete", (F.col("total") > 0) & (F.col("unique_links") >= F.col("total")))


def with_status(articles: DataFrame, on_error: str = "keep", content: str = "content",
                reason: Column | None = None) -> DataFrame:
    """Failed extraction (EXT-7): ``keep`` leaves a row whose content is ``Error: <reason>``,
    ``drop`` removes it. A failure is an empty content."""
    failed = F.col(content).isNull() | (F.length(F.col(content)) == 0)
    if on_error == "drop":
        return articles.filter(~failed).withColumn("status", F.lit("ok"))
    why = reason if reason is not None else F.lit("no content found")
    return articles.withColumn("status", F.when(failed, "error").otherwise("ok")) \
        .withColumn(content, F.when(failed, F.concat(F.lit(ERROR_PREFIX), why)).otherwise(F.col(content)))


def number_pages(pages: DataFrame, order: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``listing_no``: 1, 2, ... within each source in ``order`` (EXT-9). A live crawl stops at page
    ``MAX_LISTING_PAGES``; over a stored table every page is kept and the caller may filter. A source
    with a third of all pages is numbered by several tasks (``running_sum``)."""
    return running_sum(pages, "source", list(order), F.lit(1), "listing_no").withColumn("listing_no", F.col("listing_no").cast("int"))
