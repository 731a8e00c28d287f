"""URL filter: a trie over reversed host labels, then the path; the longest rule decides.

The trie is built on the driver from the rule list (configuration, not data)
and broadcast; `MAX_RULE_BYTES` bounds it and a longer list is an error. Each
page then walks the trie once: host labels from the right, and below every node
that ends a rule's host, the path segments from the left. The last segment of
a rule's path may be cut anywhere, so it fits every path that starts with it.

Precedence: more host labels win, then the longer path; a rule listed twice
counts once, and of an allow and a block entry for one host and path the block
entry wins.

Defined cases: a null url or one without `://` has an empty host and path and
no rule; no rule means the default verdict (allow); an empty table gives an
empty result; repeated rows are judged each for itself; only `page_id` and
`url` are read, so further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

MAX_RULE_BYTES = 64 << 20

# The rules of the query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """rules: (verdict, host, path prefix). Nodes are dicts; key None holds the path trie of a host."""
    size = sum(len(h.encode()) + len(p.encode()) for _, h, p in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of URL rules; a broadcast trie holds at most {MAX_RULE_BYTES}")
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {"next": {}, "ends": {}})
        *whole, last = path.split("/")
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "ends": {}})
        old = node["ends"].get(last)
        if old is None or verdict == "block":
            node["ends"][last] = (host + path, verdict)
    return root


def _match_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    """The longest rule path that the segments start with."""
    best = None
    for segment in segments:
        ends = node["ends"]
        if ends:
            for n in range(len(segment), -1, -1):
                hit = ends.get(segment[:n])
                if hit is not None:
                    best = hit
                    break
        node = node["next"].get(segment)
        if node is None:
            break
    return best


def match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits, or None."""
    best, node, segments = None, root, path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            best = _match_path(node[None], segments) or best
    return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    after = F.when(F.instr("url", "://") > 0,
                   F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    parts = (pages.select("page_id", after.alias("_rest"))
             .withColumn("_rest", F.substring_index(F.substring_index("_rest", "#", 1), "?", 1))
             .withColumn("_host", F.substring_index("_rest", "/", 1))
             .select("page_id", lower_ascii(F.col("_host")).alias("host"),
                     F.expr("substring(_rest, length(_host) + 1)").alias("path")))
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            hits = [match(root, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(hits, columns=["rule", "verdict"])

    return (parts.withColumn("_hit", look_up("host", "path"))
            .select("page_id", "host", "path", "_hit.rule", "_hit.verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


OP6_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r0
  FROM pages),
b AS (SELECT page_id, split_part(split_part(r0, '#', 1), '?', 1) AS r FROM a),
c AS (
  SELECT page_id,
         translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(r, length(split_part(r, '/', 1)) + 1) AS path
  FROM b),
rules(host_rule, path_rule, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT c.page_id, c.host, c.path,
         max_by(host_rule || path_rule, length(host_rule || path_rule)) AS rule,
         max_by(v, length(host_rule || path_rule)) AS v
  FROM c LEFT JOIN rules
    ON (c.host = host_rule OR ends_with(c.host, '.' || host_rule)) AND starts_with(c.path, path_rule)
  GROUP BY 1, 2, 3)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""
