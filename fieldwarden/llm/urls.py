"""URL filter: a trie over reversed host labels and path segments decides by the longest matching entry."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .registry import query

#: Most entries of one filter: the trie goes to every task, so its size is checked.
MAX_RULES = 200_000

_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}
_REST = re.compile(r"([^/?#]*)([^?#]*)")


class UrlTrie:
    """Allow and block entries by reversed host labels, then path segments.

    An entry is ``host + path`` with a path that starts with ``/``. It fits
    its host and every subdomain, and every path that starts with its path:
    whole segments are trie edges, the text after the last slash is a tail
    that the rest of a path must start with. The deepest host wins, then the
    longest path; of an allow and a block entry with the same host and path,
    block wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for count, (verdict, rule) in enumerate(rules, 1):
            if count > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} entries")
            host, slash, path = rule.partition("/")
            if verdict not in ("allow", "block") or not host or not slash:
                raise ValueError(f"not an entry: {verdict!r} {rule!r}")
            self._add(verdict, rule, host.translate(_LOWER), path)

    def _add(self, verdict: str, rule: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node.setdefault("hosts", {}).setdefault(label, {})
        *segments, tail = path.split("/")
        node = node.setdefault("paths", {})
        for segment in segments:
            node = node.setdefault("segments", {}).setdefault(segment, {})
        tails = node.setdefault("tails", {})
        if tails.get(tail, ("allow",))[0] == "allow":
            tails[tail] = (verdict, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, entry) of the longest match, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = _longest_path(node["paths"], path) or best
        return best


def _longest_path(node: dict, path: str) -> tuple[str, str] | None:
    if not path.startswith("/"):
        return None
    best, rest = None, path[1:]
    while True:
        fitting = [tail for tail in node.get("tails", ()) if rest.startswith(tail)]
        if fitting:
            best = node["tails"][max(fitting, key=len)]
        segment, slash, rest = rest.partition("/")
        node = node.get("segments", {}).get(segment) if slash else None
        if node is None:
            return best


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path after the first ``://``; both empty without one."""
    _, mark, rest = (url or "").partition("://")
    host, path = _REST.match(rest).groups() if mark else ("", "")
    return host.translate(_LOWER), path


def judged(url: Column, rules: Iterable[tuple[str, str]], default: str = "allow") -> Column:
    """Struct ``host, path, rule, verdict`` of a URL column.

    Args:
        url: URL text; null or text without ``://`` has an empty host and
            path and gets ``default``.
        rules: ``(verdict, host/path)`` entries, at most ``MAX_RULES``.
        default: Verdict where no entry fits; ``rule`` is null there.

    Only the URL column crosses to Python; other columns of the table, with
    whatever names, stay where they are. Repeated rows are judged alike.
    """
    if default not in ("allow", "block"):
        raise ValueError(f"no such verdict: {default!r}")
    trie = UrlTrie(rules)

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        found = []
        for text in urls:
            host, path = host_and_path(text)
            verdict, rule = trie.find(host, path) or (default, None)
            found.append((host, path, rule, verdict))
        return pd.DataFrame(found, columns=["host", "path", "rule", "verdict"], dtype=object)

    return judge(url)


#: Entries of the registered query (fixed values).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))

_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op4_url_filter", _SQL)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the fixed entries."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", judged(F.col("url"), RULES).alias("judged"))
    return pages.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")
