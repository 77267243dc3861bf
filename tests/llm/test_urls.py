"""URL rules against a plain loop over all rules."""

import random

import pytest
from pyspark.sql import functions as F

from shellgauge.llm import urls
from shellgauge.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, tail = rest[:end], rest[end:]
    end = min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, tail[:end]


def judged(url, rules, default="allow"):
    host, path = split(url)
    fit = [
        (len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules
        if h is not None and p is not None and a is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [
    "http://example.org/en/12?x", "https://a.b.EXAMPLE.org/es/x", "http://example.org/en/2", "https://x.com/fr/1", "x.com/de/", "http://x.com/de/#a",
    "http://com/fr/", "http://org", "http://org/", "http://org?x=/", "://", "http://", None, "", "http://a://b.org/", "http://.org/x", "http://ÄB.Org/é",
    "http://notexample.org/es/", "http://example.org/es", "http://" + "a." * 500 + "org/" + "x/" * 2000, "http://x.com\n/fr/\n",
]


@pytest.mark.parametrize("most", [10_000, 0])
def test_query_rules(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MAX_BROADCAST_ROWS", most)
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(2))
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in urls.judge(pages, rules).collect())
    want = sorted((str(r["page_id"]), *(lambda h, p, u, v: (h, p, str(u), v))(*judged(r["url"], URL_RULES))) for r in pages.collect())
    assert got == want


def test_random_rules(spark):
    dice = random.Random(3)
    host = lambda: ".".join(dice.choice(["a", "b", "example", "org"]) for _ in range(dice.randint(1, 4)))
    path = lambda: dice.choice(["", "/", "/en", "/en/", "/en/1", "/en/1/x", "/es/"])
    rules = list({(h, p): (h, p, dice.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(30))}.values())
    rules += [rules[0], (None, "/", "block"), ("a", None, "block")]
    many = [f"http://{host()}{path()}{dice.choice(['', '/z', '?q', '#f'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(many)), "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, action string")
    for r in urls.judge(pages, frame, default="block").collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(many[r["page_id"]], rules, "block"), many[r["page_id"]]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r) for r in urls.judge(pages, none).collect()] == [(1, "a", "/", None, "allow")]
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    assert urls.judge(pages.limit(0), rules).collect() == []
