"""Allow and block lists for URLs, matched by a trie over reversed host labels and path
segments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, map_texts, stored

#: Most rules (and characters in them) that one broadcast trie takes. With a longer list urls meet
#: their rules by a join.
MAX_RULES, MAX_CHARS = 1_000_000, 64_000_000

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits the host itself and all its subdomains
    path: str  # fits paths that start with it; with its leading slash, or empty


@dataclass(slots=True)
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    #: Path trie below this host: made only where a rule has this very host.
    paths: Node | None = None
    #: Rules that end inside the segment that follows this node, by the start that they ask of it,
    #: and the lengths of these starts, the longest first.
    ends: dict[str, Rule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def too_long(rules: list[Rule]) -> bool:
    return len(rules) > MAX_RULES or sum(len(r.host) + len(r.path) for r in rules) > MAX_CHARS


class UrlTrie:
    """Longest match: the rule with the longest host + path that fits wins; of two equal ones
    a block wins over an allow, and of two equal blocks or allows the longer host."""

    def __init__(self, rules: list[Rule]):
        if too_long(rules):
            raise ValueError("the rule list is too long to be broadcast")
        self.root = Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")):
                node = node.children.setdefault(label, Node())
            node.paths = node.paths or Node()
            node = node.paths
            *whole, last = rule.path.split("/")  # whole segments, then the start of one
            for segment in whole:
                node = node.children.setdefault(segment, Node())
            there = node.ends.get(last)
            if there is None or (there.verdict, rule.verdict) == ("allow", "block"):
                node.ends[last] = rule
            if len(last) not in node.lengths:
                node.lengths.append(len(last))
                node.lengths.sort(reverse=True)

    def match(self, host: str, path: str) -> Rule | None:
        best, most = None, (-1, False, 0)
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            at = node.paths
            for segment in segments:
                if at is None:
                    break
                for length in at.lengths:  # of one node's rules the longest start is the longest rule
                    rule = at.ends.get(segment[:length]) if length <= len(segment) else None
                    if rule is not None:
                        rank = (len(rule.host) + len(rule.path), rule.verdict == "block", len(rule.host))
                        if rank > most:
                            best, most = rule, rank
                        break
                at = at.children.get(segment)
        return best


def judge_urls(df: DataFrame, rules: list[Rule], default: str = "allow", url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """df with host, path, rule (host + path of the winning rule, else null) and verdict.

    A url that no rule fits gets `default`: this is a block list with exceptions. Null urls
    and those without :// have an empty host and path, and so the default. A port or user
    name is part of the host, as is an empty label. Input columns with the names of the new
    ones are replaced; repeated rows get equal results; an empty table gives an empty one. Urls of
    any length are read whole.
    """
    if too_long(rules):
        table = df.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
        return judge_by_join(df, table, default, url_col, keep)
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def make():
        match = trie.value.match

        def run(cols):
            parts = [split_url(u) for u in cols[0].to_pylist()]
            found = [match(*p) for p in parts]
            return [
                pa.array([h for h, _ in parts], pa.string()),
                pa.array([p for _, p in parts], pa.string()),
                pa.array([r and r.host + r.path for r in found], pa.string()),
                pa.array([r.verdict if r else default for r in found], pa.string()),
            ]

        return run

    return map_texts(df, make, [url_col], [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")], keep, rows=4096)


def judge_by_join(df: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """judge_urls() for rules (verdict, host, path) that are a table of any length: each url asks for the
    ends of its host, and where rules have such a host for the starts of its path that are as long
    as one of their paths."""
    new = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
    carried = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name for f in new}]
    asked = df.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col(f"`{url_col}`").alias("url"))

    def make():
        def run(cols):
            parts = [split_url(u) for u in cols[0].to_pylist()]
            return [pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string())]

        return run

    urls = stored(map_texts(asked, make, ["url"], new[:2], ["row"], rows=4096).withColumn("_row", F.monotonically_increasing_id()), "urls")
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    block = F.col("verdict") == "block"
    best = F.max(F.struct(block.alias("block"), F.concat("host", "path").alias("rule")))
    rules = stored(rules.groupBy(lower.alias("end"), F.col("path").alias("start")).agg(best.alias("best")), "rules")
    labels = F.split("host", r"\.", -1)
    ends = urls.select("_row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("end"))
    lengths = rules.groupBy("end").agg(F.collect_set(F.length("start")).alias("lengths"))  # of one host; as many as paths are long
    sizes = ends.groupBy("end").agg(F.count("*").alias("n"))
    rows = urls.count()
    met = hot_join(ends, lengths, "end", sizes, 3 * rows, "_row")
    starts = F.explode(F.filter("lengths", lambda k: k <= F.length("path")))
    key = lambda: F.concat("end", F.lit("\n"), "start").alias("key")
    probes = stored(met.select("_row", "end", "path", starts.alias("k")).select("_row", "end", F.substring("path", F.lit(1), F.col("k")).alias("start")).select("_row", key(), (F.length("end") + F.length("start")).alias("length"), F.length("end").alias("of_host")), "probes")
    found = hot_join(probes, rules.select(key(), "best"), "key", probes.groupBy("key").agg(F.count("*").alias("n")), 3 * rows, "_row")
    won = found.groupBy("_row").agg(F.max(F.struct("length", "best.block", "of_host", "best.rule")).alias("w"))
    verdict = F.when(F.col("w").isNull(), default).when(F.col("w.block"), "block").otherwise("allow")
    out = urls.join(won, "_row", "left")
    return out.select("row", "host", "path", F.col("w.rule").alias("rule"), verdict.alias("verdict")).select("row.*", "host", "path", "rule", "verdict")


#: The rules of the registered query.
RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def oracle() -> str:
    rows = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rows}),
u AS (SELECT page_id, url, row_number() OVER () AS k, coalesce(regexp_matches(url, '://'), false) AS ok FROM pages),
p AS (SELECT *, CASE WHEN ok THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN ok THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
m AS (SELECT k, rhost || rpath AS rule, r.verdict, row_number() OVER (PARTITION BY k ORDER BY length(rhost) + length(rpath) DESC, r.verdict DESC, length(rhost) DESC) AS n
  FROM p JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (k)
"""
