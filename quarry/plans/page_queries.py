"""Page extraction queries over ``pages``; SQL twins use the same regular expressions (split at
element starts where Spark uses a look-ahead)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import extract as X
from quarry.plans.registry import Tables, query

NOISE = "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->"
ANCHOR = "(?is)<a\\b[^>]*?href\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)"


def s_container(tag: str) -> str:
    return f"regexp_extract(regexp_replace(html, '{NOISE}', ' ', 'g'), '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"


def s_unescape(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def s_visible(x: str) -> str:
    t = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"
    t = s_unescape(f"regexp_replace({t}, '<[^>]*>', '', 'g')")
    t = f"regexp_replace({t}, '[ \\t\\r\\f\\x0B]+', ' ', 'g')"
    t = f"regexp_replace({t}, ' *\\n *', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({t}, '^\\s+', ''), '\\s+$', '')"


def s_items(frag: str, tag: str) -> str:
    return (f"list_transform(string_split_regex({frag}, '(?i)<{tag}\\b[^>]*>')[2:], "
            f"lambda x: split_part(x, '</{tag}>', 1))")


def s_resolve(url: str, href: str) -> str:
    origin = f"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    scheme = f"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    base0 = f"regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)', 1)"
    base = f"CASE WHEN {base0} = '' THEN {origin} || '/' ELSE {base0} END"
    return (f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
            f"WHEN starts_with({href}, '//') THEN {scheme} || ':' || {href} "
            f"WHEN starts_with({href}, '/') THEN {origin} || {href} ELSE {base} || {href} END")


LINKS = f"""a AS (SELECT page_id, url, regexp_extract_all({s_container('nav')}, '{ANCHOR}', 1) AS hrefs,
  regexp_extract_all({s_container('nav')}, '{ANCHOR}', 2) AS texts FROM pages),
b AS (SELECT page_id, url, CAST(unnest(generate_series(0, len(hrefs) - 1)) AS INTEGER) AS pos,
  unnest(hrefs) AS href, unnest(texts) AS txt FROM a),
links AS (SELECT page_id, url, pos, {s_visible('txt')} AS title, {s_resolve('url', 'trim(href)')} AS link
  FROM b WHERE trim(href) != '')"""


@query("page_links", f"WITH {LINKS} SELECT page_id, url, pos, title, link FROM links")
def q_page_links(spark, sf_dir):
    return X.extract_links(Tables(spark, sf_dir).pages)


@query("first_seen_links", f"""WITH {LINKS}
SELECT page_id, url, pos, title, link FROM links QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos) = 1""")
def q_first_seen_links(spark, sf_dir):
    return X.dedup_links(X.extract_links(Tables(spark, sf_dir).pages))


PARAS = f"""p AS (SELECT page_id, url, list_filter(list_transform({s_items(s_container('article'), 'p')},
  lambda s: {s_visible('s')}), lambda s: length(trim(s)) > 0) AS ps FROM pages)"""


@query("page_paragraphs", f"""WITH {PARAS}
SELECT page_id, url, array_to_string(ps, chr(10)) AS content, CAST(len(ps) AS INTEGER) AS paragraphs FROM p""")
def q_page_paragraphs(spark, sf_dir):
    return X.extract_paragraphs(Tables(spark, sf_dir).pages)


def _s_list_items(frag: str, tag: str) -> str:
    return (f"flatten(list_transform(regexp_extract_all({frag}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1), "
            f"lambda bl: {s_items('bl', 'li')}))")


@query("page_blocks", f"""WITH c AS (SELECT page_id, url, {s_container('article')} AS frag FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(list_concat({s_items('frag', 'p')}, {_s_list_items('frag', 'ol')},
  {_s_list_items('frag', 'ul')}), lambda s: {s_visible('s')}), lambda s: length(s) > 0) AS blocks FROM c)
SELECT page_id, url, array_to_string(blocks, ' ') AS content FROM b""")
def q_page_blocks(spark, sf_dir):
    return X.extract_blocks(Tables(spark, sf_dir).pages).select("page_id", "url", "content")


def result_info(pages: DataFrame) -> DataFrame:
    """The listing's result line, derived from each page: 'Showing 1 – k of N' with k its nav
    link count and N its html length; every 4th page shows no result line."""
    n_links = F.size(F.regexp_extract_all(X.container(F.col("html"), "nav"), F.lit("(?i)<a\\b"), 0))
    info = F.when(F.col("page_id") % 4 == 3, F.lit("No results")).otherwise(
        F.concat(F.lit("Showing 1 – "), n_links.cast("string"), F.lit(" of "), F.length("html").cast("string")))
    return pages.select("page_id", "url", info.alias("info"))


INFO = f"""info AS (SELECT page_id, url, CASE WHEN page_id % 4 = 3 THEN 'No results' ELSE 'Showing 1 – ' ||
  len(regexp_extract_all({s_container('nav')}, '(?i)<a\\b', 0)) || ' of ' || length(html) END AS info FROM pages)"""


@query("parse_result_total", f"""WITH {INFO}
SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(info, 'Showing\\s+\\d+\\s*–\\s*\\d+\\s+of\\s+(\\d+)', 1), '') AS INTEGER), 0) AS total
FROM info""")
def q_parse_result_total(spark, sf_dir):
    i = result_info(Tables(spark, sf_dir).pages)
    return i.select("page_id", X.parse_total(F.col("info")).alias("total"))


@query("crawl_report", f"""WITH {LINKS}, {INFO},
tot AS (SELECT regexp_extract(url, '{HOST}', 1) AS source,
  max(coalesce(TRY_CAST(nullif(regexp_extract(info, 'Showing\\s+\\d+\\s*–\\s*\\d+\\s+of\\s+(\\d+)', 1), '') AS INTEGER), 0)) AS total
  FROM info GROUP BY 1),
base AS (SELECT regexp_extract(url, '{HOST}', 1) AS source, count(DISTINCT page_id) AS pages FROM pages GROUP BY 1),
per AS (SELECT regexp_extract(url, '{HOST}', 1) AS source, count(*) AS links, count(DISTINCT link) AS unique_links FROM links GROUP BY 1)
SELECT source, pages, coalesce(links, 0) AS links, coalesce(unique_links, 0) AS unique_links, coalesce(tot.total, 0) AS total,
  coalesce(tot.total, 0) > 0 AND coalesce(unique_links, 0) >= coalesce(tot.total, 0) AS complete
FROM base LEFT JOIN per USING (source) LEFT JOIN tot USING (source)""")
def q_crawl_report(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    links = X.extract_links(p).withColumn("source", X.host(F.col("url")))
    totals = result_info(p).groupBy(X.host(F.col("url")).alias("source")) \
        .agg(F.max(X.parse_total(F.col("info"))).alias("total"))
    return X.crawl_report(p.select("page_id", X.host(F.col("url")).alias("source")), links, totals)


@query("extract_status", f"""WITH {PARAS}
SELECT page_id, CASE WHEN len(ps) = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN len(ps) = 0 THEN 'Error: no content found' ELSE array_to_string(ps, chr(10)) END AS content FROM p""")
def q_extract_status(spark, sf_dir):
    a = X.extract_paragraphs(Tables(spark, sf_dir).pages)
    return X.with_status(a, "keep").select("page_id", "status", "content")


@query("extract_status_drop", f"""WITH {PARAS}
SELECT page_id, array_to_string(ps, chr(10)) AS content FROM p WHERE len(ps) > 0""")
def q_extract_status_drop(spark, sf_dir):
    a = X.extract_paragraphs(Tables(spark, sf_dir).pages)
    return X.with_status(a, "drop").select("page_id", "content")


@query("pages_by_source", f"""SELECT regexp_extract(url, '{HOST}', 1) AS source, count(*) AS pages FROM pages GROUP BY 1""")
def q_pages_by_source(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    return p.groupBy(X.host(F.col("url")).alias("source")).agg(F.count(F.lit(1)).alias("pages"))


@query("listing_numbers", f"""SELECT page_id, regexp_extract(url, '{HOST}', 1) AS source,
  CAST(row_number() OVER (PARTITION BY regexp_extract(url, '{HOST}', 1) ORDER BY page_id) AS INTEGER) AS listing_no FROM pages""")
def q_listing_numbers(spark, sf_dir):
    p = Tables(spark, sf_dir).pages.select("page_id", X.host(F.col("url")).alias("source"))
    return X.number_pages(p)


@query("nested_container", """SELECT page_id, 'before é – ’ page ' || page_id || ' & after' AS content FROM pages""")
def q_nested_container(spark, sf_dir):
    """A classed container with equal elements nested in it, character references of every kind, and
    no closing tag on every third page; made from each page's id."""
    p = Tables(spark, sf_dir).pages
    tail = F.when(F.col("page_id") % 3 == 0, "").otherwise("</div><div>outside</div>")
    html = F.concat(F.lit('<div class="menu"><p>no</p></div><div id="x" class="main text wide"><div>skip</div><p>before &eacute; &ndash; &#8217; <b>page '),
                    "page_id", F.lit("</b><br></p><div><div></div><p>&amp; &#x61;fter</p></div>"), tail)
    d = p.select("page_id", "url", html.alias("html"))
    inner = X.container(F.col("html"), "div", r'class="[^"]*\btext\b')
    return X.paragraphs(d, inner).select("page_id", F.replace("content", F.lit("\n"), F.lit(" ")).alias("content"))
