import random
import re

from tidemark.llm.url_filter import filter_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("a.b.example.com", "/en/x", "block"), ("net", "", "block"), ("net", "/longer/path/", "allow"), ("com", "/", "block")]


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def check(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], rules), r


def test_against_brute_force(spark):
    r = random.Random(4)
    hosts = ["example.com", "WWW.Example.com", "a.b.example.com", "xexample.com", "com", "net", "q.net", "", "a..com", "user@example.com:80", "a." * 60 + "com"]
    paths = ["", "/", "/en/", "/en", "/en/x", "/en/xy?q=://z", "/EN/", "/longer/path/q#f", "?x=/en/", "#/en/", "/" + "p" * 3000]
    urls = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400)] + [None, "", "example.com/en/", "://", "a://b://c.com/en/", "x\n://example.com/en/"]
    check(spark, urls, RULES)


def test_empty_tables_and_other_columns(spark):
    check(spark, ["http://a.com/"], [])
    check(spark, [], RULES)
    pages = spark.createDataFrame([(1, "http://net/x", "keep", "old")], "page_id long, url string, best string, host string")
    row = filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).first()
    assert row["best"] == "keep" and row["host"] == "net" and row["verdict"] == "block"


def test_many_rules_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.url_filter.BROADCAST_RULES", 0)
    check(spark, ["http://www.example.com/en/1", "http://q.net/"], RULES)
