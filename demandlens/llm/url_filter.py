"""URL rules in a trie over reversed host labels and path segments; the longest matching rule decides.

A rule ``host/path`` fits its host and all subdomains when the url's path starts with the rule's path.
The longest rule wins: more host labels first, then the longer path; of two equal rules that differ in
the verdict, block wins. Without a rule the verdict is ``default``.

Defined cases: a null url, and one without ``://``, has an empty host and path; an empty host matches no
rule. Repeated rows stay, an empty table gives none. Only the key and the url are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast; a longer list is an error rather than a driver out of memory.
MAX_RULES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict and path of the rules that end at a node; no label or segment can have this key.
_END = None

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """``(host, path, verdict)`` rules by host labels from the last to the first, then by path segments.

    The last piece of a rule's path may end within a segment; it is kept at its node.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.translate(str.maketrans(_UPPER, _LOWER)).split(".")):
            node = node.setdefault(label, {})
        *whole, rest = path.split("/")
        node = node.setdefault("/", {})
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(_END, {})
        if ends.get(rest, ("", "allow"))[1] != "block":
            ends[rest] = (f"{host}{path}", verdict)
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The longest rule and its verdict."""
    found, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if "/" in node:
            found = _in_path(node["/"], path) or found
    return found


def _in_path(node: dict, path: str) -> tuple[str, str] | None:
    found, segments = None, path.split("/")
    for segment in segments:
        ends = node.get(_END)
        if ends:
            fits = [rest for rest in ends if segment.startswith(rest)]
            if fits:
                found = ends[max(fits, key=len)]
        node = node.get(segment)
        if node is None:
            break
    return found


def judge(df: DataFrame, rules: Iterable[tuple[str, str, str]], key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            found = [look_up(root, h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    parts = df.select(
        key,
        F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), _UPPER, _LOWER).alias("host"),
        F.coalesce(F.regexp_extract(url, URL, 2), F.lit("")).alias("path"),
    )
    return parts.withColumn("found", match("host", "path")).select(key, "host", "path", "found.rule", "found.verdict")
