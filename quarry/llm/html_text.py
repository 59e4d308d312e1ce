"""Main text of web pages from flat text blocks.

A page is read once into a flat list of text blocks (text between block-level tags) with the words,
the share of words that stand in links, and two marks of place: whether the block stands in the
page's article, and whether it stands in furniture (navigation, footers, sidebars, notices, adverts,
forms, reader comments, hidden parts). A decision tree over these features of a block and of its two
neighbours says which blocks are main text. The tree is grown from ``LABELLED``, a small labelled
table below, each time the operator is set up.

Defined results: null html is empty and gives the empty text; a page cut off in a tag, comment or
script ends there, what stands before is kept; unclosed and stray tags are tolerated; character
references are decoded once; ``br`` is white space; pages without any article mark are judged by
words and link density alone; a page listed twice is extracted twice; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import col, map_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(?=[^a-zA-Z/!?]|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is in these is no text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title select option datalist button textarea".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog search label fieldset".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay subscribe subscription newsletter signup login form search share sharing social related recommended "
    "recommendations comment comments commentlist discussion disqus reply replies respond widget pagination pager copyright legal "
    "skip hidden metadata tags tagcloud byline".split())
ARTICLE = frozenset("article articlebody post entry story".split())
CLOSES_P = BLOCK - {"body", "html"}
WORD = re.compile(r"\w+")

FEATURES = ("furniture", "in_article", "page_has_article", "words", "links", "words_before", "links_before", "words_after", "links_after")
#: Small labelled table: features of a block as in ``FEATURES`` (links: share of words in links), then 1 for main text.
LABELLED = [
    # an article is marked, the block is in it
    (0, 1, 1, 1, 0.0, 0, 0.0, 120, 0.0, 1), (0, 1, 1, 2, 0.0, 80, 0.0, 60, 0.0, 1), (0, 1, 1, 9, 0.0, 0, 0.0, 90, 0.0, 1),
    (0, 1, 1, 60, 0.0, 9, 0.0, 70, 0.0, 1), (0, 1, 1, 140, 0.0, 60, 0.0, 40, 0.0, 1), (0, 1, 1, 35, 0.2, 50, 0.0, 44, 0.1, 1),
    (0, 1, 1, 18, 0.5, 70, 0.0, 52, 0.0, 1), (0, 1, 1, 6, 1.0, 64, 0.0, 70, 0.0, 1), (0, 1, 1, 12, 0.9, 30, 0.1, 45, 0.0, 1),
    (0, 1, 1, 300, 0.1, 20, 0.0, 5, 0.0, 1), (0, 1, 1, 4, 0.0, 3, 0.0, 5, 0.0, 1), (0, 1, 1, 1, 0.0, 1, 0.0, 1, 0.0, 1),
    (0, 1, 1, 25, 0.0, 40, 0.0, 3, 1.0, 1), (0, 1, 1, 8, 0.0, 2, 1.0, 30, 0.0, 1), (0, 1, 1, 3, 0.0, 1, 0.0, 0, 0.0, 1),
    (0, 1, 1, 5, 1.0, 40, 0.0, 0, 0.0, 1), (0, 1, 1, 70, 0.6, 10, 0.0, 15, 0.2, 1), (0, 1, 1, 2, 1.0, 90, 0.0, 25, 0.0, 1),
    # an article is marked, the block is outside of it
    (0, 0, 1, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 0, 1, 2, 1.0, 1, 1.0, 2, 1.0, 0), (0, 0, 1, 12, 0.0, 2, 1.0, 10, 0.0, 0),
    (0, 0, 1, 30, 0.0, 0, 0.0, 9, 0.0, 0), (0, 0, 1, 45, 0.1, 80, 0.0, 7, 0.3, 0), (0, 0, 1, 7, 0.0, 90, 0.0, 0, 0.0, 0),
    (0, 0, 1, 120, 0.0, 60, 0.0, 30, 0.0, 0), (0, 0, 1, 9, 0.3, 70, 0.0, 0, 0.0, 0), (0, 0, 1, 3, 0.0, 1, 1.0, 8, 0.0, 0),
    # furniture, in the article or not
    (1, 1, 1, 14, 0.0, 60, 0.0, 50, 0.0, 0), (1, 1, 1, 60, 0.0, 80, 0.0, 20, 0.0, 0), (1, 1, 1, 4, 1.0, 3, 1.0, 4, 1.0, 0),
    (1, 1, 1, 150, 0.0, 40, 0.0, 70, 0.0, 0), (1, 1, 1, 2, 0.0, 30, 0.0, 45, 0.0, 0), (1, 0, 1, 1, 1.0, 1, 1.0, 1, 1.0, 0),
    (1, 0, 1, 8, 0.0, 2, 1.0, 9, 0.0, 0), (1, 0, 1, 90, 0.0, 50, 0.0, 6, 0.0, 0), (1, 0, 0, 1, 1.0, 0, 0.0, 2, 1.0, 0),
    (1, 0, 0, 20, 0.0, 1, 1.0, 60, 0.0, 0), (1, 0, 0, 40, 0.0, 90, 0.0, 35, 0.0, 0), (1, 0, 0, 110, 0.0, 70, 0.0, 0, 0.0, 0),
    (1, 0, 0, 6, 0.5, 110, 0.0, 0, 0.0, 0), (1, 0, 0, 3, 0.0, 45, 0.0, 80, 0.0, 0), (1, 0, 0, 250, 0.0, 120, 0.0, 60, 0.0, 0),
    # no article is marked
    (0, 0, 0, 60, 0.0, 8, 0.0, 75, 0.0, 1), (0, 0, 0, 120, 0.1, 60, 0.0, 40, 0.0, 1), (0, 0, 0, 30, 0.1, 90, 0.0, 55, 0.0, 1),
    (0, 0, 0, 8, 0.0, 70, 0.0, 80, 0.0, 1), (0, 0, 0, 3, 0.0, 44, 0.0, 60, 0.0, 1), (0, 0, 0, 9, 0.0, 1, 1.0, 85, 0.0, 1),
    (0, 0, 0, 20, 0.0, 4, 0.0, 25, 0.0, 1), (0, 0, 0, 45, 0.2, 100, 0.0, 3, 0.9, 1), (0, 0, 0, 1, 0.0, 30, 0.0, 22, 0.0, 1),
    (0, 0, 0, 14, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 6, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 0, 5, 0.0, 0, 0.0, 70, 0.0, 1),
    (0, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 0, 0, 2, 1.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 5, 0.8, 1, 1.0, 60, 0.0, 0),
    (0, 0, 0, 12, 0.9, 9, 0.9, 11, 1.0, 0), (0, 0, 0, 25, 0.7, 12, 0.9, 14, 0.8, 0), (0, 0, 0, 4, 1.0, 70, 0.0, 2, 1.0, 0),
    (0, 0, 0, 3, 0.6, 110, 0.0, 4, 1.0, 0), (0, 0, 0, 7, 1.0, 5, 1.0, 0, 0.0, 0), (0, 0, 0, 40, 0.9, 3, 1.0, 6, 1.0, 0),
]


def grow(rows: list[tuple], depth: int = 8):
    """Decision tree by Gini impurity: (feature, threshold, left, right) or a label. Equal gains take
    the first feature and the lowest threshold, so the same table gives the same tree."""
    y = np.array([r[-1] for r in rows])
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    x = np.array([r[:-1] for r in rows], float)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] < t
            impurity = sum(part.sum() * (p := y[part].mean()) * (1 - p) for part in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    return (f, float(t), grow([r for r in rows if r[f] < t], depth - 1), grow([r for r in rows if r[f] >= t], depth - 1))


def decide(tree, features) -> int:
    while isinstance(tree, tuple):
        f, t, left, right = tree
        tree = left if features[f] < t else right
    return tree


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(furniture, article) that an opening tag says of what is in it."""
    furniture = tag in FURNITURE_TAGS or (tag == "header" and not in_article)
    article = tag in ("article", "main")
    if attributes.strip():
        names: set[str] = set()
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                names.update(re.split(r"[^a-z]+", value))
            elif name == "itemprop":
                article |= value == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                furniture = True
        furniture |= bool(names & FURNITURE) and tag not in ("body", "html")
        article |= bool(names & ARTICLE) and tag in ("div", "section") and not furniture
        if article and tag in ("article", "main") and not names & (FURNITURE - {"header", "hidden", "tags", "related"}):
            furniture = False
    return furniture, article


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """(text, words, share of words in links, furniture, in article) of each block in page order."""
    out: list[tuple[str, int, float, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    open_: dict[str, int] = {}
    text: list[str] = []
    linked: list[str] = []
    links = skipped = 0

    def close() -> None:
        nonlocal text, linked
        if text:
            s = " ".join(html_lib.unescape("".join(text)).split())
            if s:
                n = len(WORD.findall(s))
                in_links = len(WORD.findall(html_lib.unescape(" ".join(linked)))) if linked else 0
                out.append((s, n, min(1.0, in_links / n) if n else 0.0, stack[-1][1], stack[-1][2]))
        text, linked = [], []

    def pop(tag: str) -> None:
        nonlocal links, skipped
        while True:
            t = stack.pop()[0]
            open_[t] -= 1
            links -= t == "a"
            skipped -= t in SKIPPED
            if t == tag:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skipped:
            text.append(page[at:stop])
            if links:
                linked.append(page[at:stop])
        if not m:
            break
        at = max(m.end(), stop + 1)
        if m.group(2) is None:
            if m.group() == "<" and not skipped:  # a lone sign, not a tag
                text.append("<")
            continue
        tag, closing = m.group(2).lower(), m.group(1)
        if not page.endswith(">", 0, m.end()):
            break  # the page ends within this tag
        if tag == "br":
            text.append(" ")
        if tag in BLOCK:
            close()
        if closing:
            if open_.get(tag):
                pop(tag)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and open_.get("p"):
            pop("p")
        for same in ("li", "option"):
            if tag == same and stack[-1][0] == same:
                pop(same)
        if tag in ("dt", "dd") and stack[-1][0] in ("dt", "dd"):
            pop(stack[-1][0])
        if tag in ("td", "th", "tr") and stack[-1][0] in ("td", "th"):
            pop(stack[-1][0])
        if tag == "tr" and stack[-1][0] == "tr":
            pop("tr")
        if tag == "a" and open_.get("a"):
            pop("a")
        furniture, article = _marks(tag, m.group(3), stack[-1][2])
        if tag in RAW:  # no tags are read inside
            z = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = z.end() if z else end
            continue
        if m.group(3).endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, stack[-1][1] or furniture, stack[-1][2] or article))
        open_[tag] = open_.get(tag, 0) + 1
        links += tag == "a"
        skipped += tag in SKIPPED
    close()
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    has = any(b[4] for b in found)
    keep = []
    for i, (s, n, ld, furniture, inside) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        if decide(tree, (furniture, inside, has, n, ld, *before, *after)):
            keep.append(s)
    return "\n".join(keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled=None) -> DataFrame:
    """Per page row: id, url, ``text`` (main text) and ``n_chars`` (its code points)."""
    tree = grow(LABELLED if labelled is None else labelled)
    src = pages.select(col(id_col), col(url_col), F.coalesce(col(html_col), F.lit("")).cast("binary").alias("__html"))
    schema = T.StructType([*src.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [main_text(x.decode("utf-8", "replace"), tree) for x in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(done, pa.string()), pa.array([len(s) for s in done], pa.int64())],
                                          names=schema.names)

    return map_batches(src, schema, run, "__html")
