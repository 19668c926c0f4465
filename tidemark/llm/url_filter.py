"""URL rules: allow and block lists of host and path prefixes.

A url is expanded into expressions, one for each suffix of its host at a dot and each prefix of its
path, as far as some rule has that many labels and that path length. Expressions meet rules in an
equi-join on the first 32 bits of their SHA-256; whole digests confirm a match, then the longest
rule wins. Urls are expanded once for each distinct (host, path), so repeated ones cost nothing more.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule. Hosts
are compared after lower-casing A-Z, paths as they are. Of rules with one text, block wins. No
rules, no urls: fine. Other columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule table up to this many rows (of short strings) is broadcast; a larger one is shuffled.
BROADCAST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _keyed(df: DataFrame, text: str) -> DataFrame:
    digest = F.unhex(F.sha2(F.col(text), 256))
    return df.withColumn("digest", digest).withColumn("prefix", F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"))


def filter_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains where
    the url's path starts with the rule's path. The verdict is the rule's, else ``default``. A null path is
    empty; a rule with a null or empty host fits nothing and is left out; of rules with one host and path block wins.
    """
    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    clean = clean.where("rule_host <> ''").withColumn("rule_text", F.concat("rule_host", F.lit("\n"), "rule_path"))
    clean = clean.groupBy("rule_text").agg(F.first("rule_host").alias("rule_host"), F.first("rule_path").alias("rule_path"), F.max("rule_verdict").alias("rule_verdict"))
    labels = F.size(F.split("rule_host", r"\."))
    # Bounded by the most labels of a rule's host and the longest rule's path, not by the table.
    shape = clean.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(labels)).alias("labels"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    n, depths, lengths = shape["n"], shape["labels"] or [0], shape["lengths"] or [0]

    urls = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    kinds = urls.select("host", "path").where("host <> ''").distinct()
    suffixes = F.explode(F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in depths])))
    starts = F.explode(F.array_distinct(F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda p: p.isNotNull())))
    expressions = _keyed(kinds.withColumn("suffix", suffixes).withColumn("start", starts).withColumn("text", F.concat("suffix", F.lit("\n"), "start")), "text")
    keyed = _keyed(clean, "rule_text").select("prefix", F.col("digest").alias("rule_digest"), "rule_host", "rule_path", "rule_verdict")
    met = expressions.join(F.broadcast(keyed) if n <= BROADCAST_RULES else keyed, "prefix").where("digest = rule_digest")
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.col("rule_verdict").alias("found"), F.concat("rule_host", "rule_path").alias("rule"))
    best = met.groupBy("host", "path").agg(F.max(order).alias("_best")).select("host", "path", "_best")
    out = urls.join(best, ["host", "path"], "left")
    return out.select(*[c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "_best")], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.found", F.lit(default)).alias("verdict"))
