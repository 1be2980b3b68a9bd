"""URL filter: a broadcast trie over reversed host labels and path segments.

A rule is (host, path, action).  It fits its host and every subdomain, if the
url's path starts with the rule's path.  Of the rules that fit, the one with
the longest ``host + path`` wins; at equal length the longer host, then
``block``.  A url that no rule fits gets the default verdict.

Defined results: a null url or one without ``://`` has empty host and path,
which no rule with a host fits; an empty rule host fits every url.  Repeated
rules count once (``block`` before ``allow``).  The urls' other columns, whatever
their names, stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The trie travels to every executor, so the rule list has a fixed bound
#: (about 200 bytes a rule); a longer list is matched by ``filter_urls_joined``.
MAX_TRIE_RULES = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class UrlTrie:
    """Nested dictionaries: host labels from the top level down, then whole
    path segments; a node's tails are path rests that end inside a segment."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root = self._node()
        for host, path, action in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["hosts"].setdefault(label, self._node())
            *segments, tail = path.split("/")
            for segment in segments:
                node = node["paths"].setdefault(segment, self._node())
            rank = (len(host) + len(path), len(host), action == "block")
            old = node["tails"].get(tail)
            if old is None or old[0] < rank:
                node["tails"][tail] = (rank, host + path, action)

    @staticmethod
    def _node() -> dict:
        return {"hosts": {}, "paths": {}, "tails": {}}

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        labels = list(reversed(host.split("."))) if host else []
        segments = path.split("/")
        node, depth = self.root, 0
        while node is not None:
            at, i = node, 0
            while at is not None:
                for tail, found in at["tails"].items():
                    if (best is None or found[0] > best[0]) and segments[i].startswith(tail):
                        best = found
                # a whole segment ends with a slash, so the last one has no child
                at = at["paths"].get(segments[i]) if i + 1 < len(segments) else None
                i += 1
            node = node["hosts"].get(labels[depth]) if depth < len(labels) else None
            depth += 1
        return best and best[1:]


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``, both empty without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), URL_PARTS, i), F.lit(""))
    return df.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url",
                default: str = "allow") -> DataFrame:
    """``df`` with ``host, path, rule, verdict`` (columns of these names are replaced).

    Only the two url parts go to Python; ``rule`` is null where none fits.
    """
    if len(rules) > MAX_TRIE_RULES:
        return filter_urls_joined(df, df.sparkSession.createDataFrame(
            list(rules), "host string, path string, action string"), url, default)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.match
        for hosts, paths in parts:
            found = [match(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    out = url_parts(df, url).withColumn("__judged", judge("host", "path"))
    return out.withColumns({"rule": F.col("__judged.rule"),
                            "verdict": F.col("__judged.verdict")}).drop("__judged")


def filter_urls_joined(df: DataFrame, rules: DataFrame, url: str = "url",
                       default: str = "allow") -> DataFrame:
    """The same for a rule table too long for a trie on every executor.

    Distinct (host, path) pairs list their own host suffixes, which are joined to
    the rules' hosts; a pair's fitting rules meet in a partial ``max``.
    """
    parts = url_parts(df, url)
    pairs = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("__rh"), F.col("path").alias("__rp"),
                     F.col("action").alias("__ra"))
    hits = (pairs.select("host", "path", F.explode(F.array_distinct(
                F.concat(suffixes, F.array(F.lit(""))))).alias("__rh"))
            .join(r, "__rh").where(F.startswith(F.col("path"), F.col("__rp"))))
    rank = F.struct((F.length("__rh") + F.length("__rp")).alias("a"), F.length("__rh").alias("b"),
                    (F.col("__ra") == "block").alias("c"),
                    F.concat("__rh", "__rp").alias("rule"), F.col("__ra").alias("action"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("__best"))
    return (parts.join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("__best.rule"),
                          "verdict": F.coalesce(F.col("__best.action"), F.lit(default))})
            .select(*parts.drop("rule", "verdict").columns, "rule", "verdict"))
