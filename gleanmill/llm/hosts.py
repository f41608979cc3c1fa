"""URL filters: fixed rules first, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages are counted by host, once; that small table is written, and all levels are derived from it.
A beta-binomial prior flows from all pages to the suffix, from there to the registered domain and to the host, so that
a host with few labels looks like its domain and one without any looks like its suffix. A page is blocked if the lower
bound of its host's posterior rate of bad pages is above a limit. Everything is a native column expression.

The suffix is the last label of a host, or the last two where a country's domain has a usual second level (SECOND); the
registered domain has one label more. User, port and a final dot play no part in them. A host of numbers is its own
domain, and all of them share one suffix.

Null urls and urls without `://` have an empty host and path; they fit no rule, and the method judges the empty
host like any other. Repeated rows are judged alike, rows without a page_id by their url. Where a page has several
outcomes a bad one counts. Long urls are read whole. Extra columns of the inputs are ignored. Empty tables give empty
results, and without labels nothing is blocked by the method.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only, salted_join

#: (verdict, host, path). Fixed values of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Usual second levels below the domain of a country.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "go", "ne", "net", "nom", "or", "org")
#: Standard errors below the posterior mean, and the rate of bad pages above which a host is blocked.
Z = 1.645
MAX_BAD = 0.5
#: A prior counts as at least and at most so many pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null. The rules are a short list, part of the plan."""
    rule = verdict = None
    for say, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def _levels(df: DataFrame) -> DataFrame:
    """With suffix and (registered) domain of host."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"(:[0-9]*)?[.]?$", "")
    labels = F.split(bare, r"[.]")
    n = F.size(labels)
    wide = (n >= 3) & (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(*SECOND)
    k = F.when(wide, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    numbers = bare.rlike(r"^[0-9.]+$|^\[")
    return df.withColumn("suffix", F.when(numbers, "#").otherwise(last(k))).withColumn("domain", F.when(numbers, bare).otherwise(last(k + 1)))


def _strength(df: DataFrame, mean: str) -> float:
    """Method of moments: how many pages the parent's rate is worth, from the spread of the children's rates."""
    n, p, m = F.col("n"), F.col("bad") / F.col("n"), F.col(mean)
    row = df.filter("n > 0").agg(F.sum(n * (p - m) * (p - m)), F.sum(m * (1 - m)), F.sum(n), F.sum(n * m * (1 - m))).first()
    if row[2] is None:
        return MOST_STRENGTH
    spread, noise, pages, within = (float(x) for x in row)
    between = (spread - noise) / pages
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, within / pages / between - 1)) if between > 0 else MOST_STRENGTH


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: (host, bad: 0, 1 or null if unlabelled), a row per page. A row per host with its posterior."""
    counted = only(outcomes, "host", "bad").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = cut(_levels(counted), "hosts")
    everything = hosts.agg(F.sum("n"), F.sum("bad")).first()
    base = (float(everything[1] or 0) + 0.5) / (float(everything[0] or 0) + 1)
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("prior", F.lit(base))
    shrunk = lambda s: ((F.col("bad") + F.col("prior") * s) / (F.col("n") + s)).alias("prior")
    of_suffix = suffixes.select("suffix", shrunk(_strength(suffixes, "prior")))
    # The domains of one suffix, and the hosts of one domain, may be most of the table.
    domains = salted_join(domains, of_suffix, ["suffix"], "domain")
    of_domain = domains.select("suffix", "domain", shrunk(_strength(domains, "prior")))
    parent = salted_join(hosts, of_domain, ["suffix", "domain"], "host")
    s = _strength(parent, "prior")
    a, b = F.col("bad") + F.col("prior") * s, F.col("n") - F.col("bad") + (1 - F.col("prior")) * s
    out = parent.withColumn("bad_rate", a / (a + b))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return out.select("host", "domain", "suffix", F.col("n").alias("n_labelled"), "bad_rate", F.greatest(F.lit(0.0), F.col("bad_rate") - Z * sd).alias("bad_least"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """pages: (page_id, url); outcomes: (page_id, bad). Verdicts: a rule's, else by the bound of the host's posterior."""
    seen = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = only(outcomes, "page_id", "bad").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    scores = cut(reputation(seen.join(known, "page_id", "left")), "reputation")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    out = seen.join(scores, "host", "left")
    method = F.when(F.col("bad_least") > max_bad, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_least", "n_labelled")


def outcomes_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages whose path names a labelled document: bad if its quality is 0 or it is toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[^0-9]|\z)", 1)
    named = only(pages, "page_id", "url").withColumn("n", number).select("page_id", F.expr("try_cast(nullif(n, '') as bigint)").alias("doc_id"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    return named.filter("doc_id is not null").join(only(labels, "doc_id", "quality", "toxic").select("doc_id", bad), "doc_id").select("page_id", "bad")
