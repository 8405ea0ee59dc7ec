"""URL filter against trying every entry."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fieldwarden.llm.urls import UrlTrie, host_and_path, judged


def plain(rules, host, path):
    """The longest fitting entry by host labels, then path; block before allow."""
    fitting = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fitting.append((h.count("."), len(p), verdict == "block", verdict, rule))
    return max(fitting)[3:] if fitting else None


def test_trie_finds_the_longest_entry():
    draw = random.Random(3)
    hosts = ["org", "a.org", "b.a.org", "com", "x.com", "Y.x.com"]
    paths = ["", "a", "a/", "a/b", "a/b/c", "/", "a//", "ab"]
    rules = [(draw.choice(["allow", "block"]), f"{draw.choice(hosts)}/{draw.choice(paths)}") for _ in range(30)]
    trie = UrlTrie(rules)
    for _ in range(3000):
        host = ".".join(draw.choices(["a", "b", "x", "y", "org", "com", ""], k=draw.randint(1, 4)))
        path = draw.choice(["", "/"]) + "/".join(draw.choices(["a", "b", "c", "ab", ""], k=draw.randint(0, 4)))
        assert trie.find(host, path) == plain(rules, host, path), (host, path)


def test_host_and_path():
    assert host_and_path("HTTP://Ab.C/x?y#z") == ("ab.c", "/x")
    assert host_and_path("a://b://c") == ("b:", "//c")
    assert host_and_path("x://ÄB?/a") == ("Äb", "")
    assert host_and_path("www.a.org/x") == host_and_path(None) == host_and_path("") == ("", "")


def test_column(spark):
    rows = [(1, "http://a.org/x", "keep"), (2, None, "keep"), (1, "http://a.org/x", "keep"), (3, "http://b.net/" + "y" * 50_000, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = df.withColumn("j", judged(F.col("url"), [("block", "a.org/")], "allow")).orderBy("page_id").collect()
    assert [(r.page_id, r.host, r.j.rule, r.j.verdict) for r in got] == [
        (1, "keep", "a.org/", "block"), (1, "keep", "a.org/", "block"), (2, "keep", None, "allow"), (3, None, None, "allow")]
    assert df.limit(0).select(judged(F.col("url"), [])).collect() == []


@pytest.mark.parametrize("rules", [[("deny", "a.org/")], [("allow", "/x")], [("allow", "a.org")]])
def test_broken_entries(rules):
    with pytest.raises(ValueError):
        UrlTrie(rules)
