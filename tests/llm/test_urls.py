from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from botica.llm.urls import RULES, _numbers, url_verdicts

SCHEMA = "page_id long, url string, html string, host string, path string, rule string, row long, features string"
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.NET/en/1", "http://example.net", "http://example.net/EN/x",
    "https://example.netx/en/", "http://a.b.example.com/de/?q=1", "http://example.com/de", "http://notexample.com/de/1",
    "ftp://x.org/fr/#a?b", "http://x.org?/fr/", "http://x.org#/fr/", "http://org/fr/1", "http://net/", "http://a.net?x",
    "a://b://c/d", "x#y://z.net/p", "http://ünï.net/en/\nnew?x", "http://u:p@host.net:80/a/b.html?x=1&y=2&z", "/" * 5000,
    "http://example.com/de/" + "x" * 20000,
]


def plain(url):
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for rule, verdict in RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return host, path, max(fits) if fits else None


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, "h", "H", "P", "R", k, "f") for k, u in enumerate(URLS)] * 2 + [(None, URLS[5], *[None] * 6)]
    found = url_verdicts(spark.createDataFrame(rows, SCHEMA), trees=2).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]), r.url
        assert r.verdict == rule[2] if rule else r.verdict in ("allow", "block")


def test_entropy_is_that_of_characters(spark):
    urls = [*URLS, "aab", "\U0001f600\U0001f600x", "\u2028\n\u2028", "ab" * 200_000, "x" * 1_000_000]
    rows = [(u, *plain(u)[:2]) for u in urls]
    found = _numbers(spark.createDataFrame(rows, "url string, host string, path string")).select("url", "entropy").collect()
    assert len(found) == len(urls)
    for r in found:
        url = r.url or ""
        shares = [c / len(url) for c in Counter(url).values()]
        assert r.entropy == pytest.approx(-sum(s * math.log2(s) for s in shares), abs=1e-9), url[:40]


def test_trees_learn_what_the_rules_say(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = url_verdicts(pages).collect()
    ruled = [r for r in found if r.rule]
    right = [(r.score >= 0.5) == (r.verdict == "block") for r in ruled]
    assert len(found) == pages.count() and sum(right) / len(right) > 0.95
    assert all(r.verdict == ("block" if r.score >= 0.5 else "allow") for r in found if not r.rule)


@pytest.mark.parametrize("url,verdict", [("http://a.net/x", "block"), ("http://a.org/fr/", "allow"), ("http://b.com/", "allow")])
def test_one_verdict_only(spark, url, verdict):
    pages = spark.createDataFrame([(1, url), (2, "http://c.com/")], "page_id long, url string")
    assert {r.id: r.verdict for r in url_verdicts(pages).collect()} == {1: verdict, 2: verdict}


def test_nothing(spark):
    assert url_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0
