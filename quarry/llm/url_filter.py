"""URL filter: exact host/path rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (good or not) are counted by host. Good rates are shrunk from the whole
table to the suffix (last label, or two that ``SUFFIXES`` lists), from there to the registered domain
(suffix and one label more), and from there to the host; a user part and a port belong to none of the
three, and an address of numbers is its own domain and suffix: at each level the prior is a beta distribution around the parent's
posterior mean, its strength fitted by moments (the intra-class correlation ``rho`` of a
beta-binomial; strength = 1/rho - 1). A host without labelled pages has its domain's mean, else its
suffix's, else that of the whole table, under the strength of the host level. A host is blocked if the
upper bound (mean + ``z`` standard deviations) of its posterior good rate is below ``min_rate``. All of
it is aggregation and joins.

Defined results: null urls and urls without ``://`` have empty host and path, match no rule and take
the verdict of the empty host, and so do others alike; pages without a labelled outcome add nothing to the counts but get a
verdict; a page listed twice is judged twice; labels that repeat or are null count by row or not at
all; without any labelled page each host's posterior is uniform, whose upper bound allows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import col, stored

#: Bounds of the fitted correlation, so that strengths lie between 1 and 9999.
RHO = (1e-4, 0.5)

# Public suffixes of two labels under which domains are registered. A caller may give more.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "co.za",
            "com.ar", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw")


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host):
    """The host and every parent of it, longest first."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def registered(host, listed=SUFFIXES):
    """(suffix, registered domain) of a host."""
    site = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    labels = F.split(site, r"\.", -1)
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = last(2).isin(*listed) if listed else F.lit(False)
    number = site.rlike(r"^[0-9.]+$|^\[")
    return (F.when(number, site).when(two, last(2)).otherwise(last(1)), F.when(number, site).when(two, last(3)).otherwise(last(2)))


def rule_match(host, path, rules: list[tuple[str, str]]):
    """(rule, verdict) of the longest rule that fits; null without one. ``rules`` is a short list
    of (``host/path``, ``allow`` or ``block``) held in the plan; equal lengths: longer host first."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.array(*[F.struct(F.lit(len(r)).alias("n"), F.lit(r.find("/")).alias("hn"), F.lit(r).alias("rule"),
                               F.lit(v).alias("verdict"), F.lit(r.split("/", 1)[0]).alias("h"),
                               F.lit(r[r.find("/"):]).alias("p")) for r, v in rules])
    fits = F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    best = F.array_max(fits)
    return F.when(F.size(fits) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def reputation(outcomes: DataFrame, z: float = 1.645, hosts: DataFrame | None = None, listed=SUFFIXES) -> DataFrame:
    """Hosts of ``outcomes(host, good 0/1)``, and of ``hosts(host)`` if given (repeats count once), with n,
    good, posterior mean, lower and upper bound. The driver sees one row of totals for each level."""
    suffix_of, domain_of = registered(F.col("host"), listed)
    rows = outcomes.where("good is not null").select("host", F.lit(1).alias("n"), F.col("good").cast("long").alias("g"))
    if hosts is not None:
        rows = rows.union(hosts.select("host", F.lit(0), F.lit(0).cast("long")))
    units = stored(rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
                   .withColumn("suffix", suffix_of).withColumn("domain", domain_of), "hosts")
    known = units.where("n > 0")
    total = known.agg(F.sum("g").alias("g"), F.sum("n").alias("n")).first()
    root = F.lit(((total["g"] or 0) + 0.5) / ((total["n"] or 0) + 1))
    counts = (F.sum("n").alias("n"), F.sum("g").alias("g"))
    suffix = _shrunk(known.groupBy("suffix").agg(*counts).withColumn("parent", root)).select("suffix", F.col("mean").alias("s_mean"))
    domain = known.groupBy("domain", "suffix").agg(*counts)
    domain = _shrunk(domain.join(suffix.withColumnRenamed("s_mean", "parent"), "suffix")).select("domain", F.col("mean").alias("d_mean"))
    out = _shrunk(units.join(domain, "domain", "left").join(suffix, "suffix", "left").withColumn("parent", F.coalesce("d_mean", "s_mean", root)))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + F.col("n") + 1))
    return out.select("host", "domain", "suffix", "n", F.col("g").alias("good"), "mean",
                      F.greatest(F.col("mean") - z * sd, F.lit(0.0)).alias("lower"), F.least(F.col("mean") + z * sd, F.lit(1.0)).alias("upper"))


def _shrunk(units: DataFrame) -> DataFrame:
    """``units(n, g, parent mean)`` with the posterior ``mean`` under one ``strength``, fitted to the units
    with n > 0; without any it is 2, that of a uniform distribution."""
    m, n = F.col("parent"), F.col("n")
    fit = units.where("n > 0").agg(F.count("*").alias("units"), F.sum(n * F.pow(F.col("g") / n - m, 2) - m * (1 - m)).alias("over"),
                    F.sum(m * (1 - m) * (n - 1)).alias("room")).first()
    rho = min(max(fit["over"] / fit["room"] if fit["room"] else RHO[0], RHO[0]), RHO[1])
    strength = F.lit(1 / rho - 1 if fit["units"] else 2.0)
    return units.withColumn("strength", strength).withColumn("mean", (strength * m + F.col("g")) / (strength + n))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], min_rate: float = 0.7, z: float = 1.645,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the host's reputation (``mean``, ``upper``), which
    every host of the pages has."""
    url = col(url_col)
    rows = pages.select(col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    rep = reputation(outcomes, z, rows.select("host")).select("host", "mean", "upper")
    rows = rows.join(rep, "host")
    rule = rule_match(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < min_rate, "block").otherwise("allow")
    rows = rows.withColumn("r", rule)
    return rows.select(id_col, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "mean", "upper")
