"""Licence scan with a positional rare-token index, in DataFrame operations only.

Templates are licence sentences. Their words (function words aside) form the
index vocabulary. One pass over the texts keeps, per file, the number of
words and the places of vocabulary words. Document frequencies over all files give
each word's IDF; the `ANCHORS` words of highest IDF in a template's mandatory key
phrase are its anchors.

A file is looked up by its anchor words: files without any drop out. The places of the
others join the template postings word by word, and each pair of places votes for
the start at which the template would stand (place in file minus place in
template). A start is a hit if two anchors (or the only one) vote for it and every word
of the template's mandatory key phrase stands at its place; its score is the
share of the template's indexed words that do. So words may be changed or
missing around the key phrase, which itself must stand whole.

The base phrases are templates that are all key phrase. A key phrase holds no function
words.

Counting by (file, template, start) is a plain grouped aggregation with
map-side sums: neither a frequent word nor a long file is gathered anywhere.

Defined cases: null text is empty: no words, no labels, score 0; empty table:
empty result; repeated rows and ids: each row for itself; null ids are carried
along; only doc_id and text are read, so further columns play no part.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLAIN_WORD, Scratch, lower_ascii, table

ANCHORS = 3

# The base phrases and their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
# Label, licence sentence, mandatory key phrase.
TEMPLATES = [
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
]
# Function words: counted as places, but not indexed.
_COMMON = {"the", "of", "and", "to", "in", "is", "a", "are", "or", "with", "for"}

_WORDS = re.compile(r"[a-z0-9]+")


def _templates(templates: list, base: list) -> list[tuple[int, str, bool, list[tuple[str, int]], set[int]]]:
    """id, label, base, indexed (word, place), places of the key phrase's indexed words."""
    out = []
    for label, text, key, is_base in [(la, p, p, True) for la, p in base] + [(la, s, k, False) for la, s, k in templates]:
        words, phrase = _WORDS.findall(text), _WORDS.findall(key)
        at = next((i for i in range(len(words)) if words[i:i + len(phrase)] == phrase), None)
        if at is None:
            raise ValueError(f"key phrase {key!r} is not in its template")
        indexed = [(w, i) for i, w in enumerate(words) if is_base or w not in _COMMON]
        keys = {i for _, i in indexed if at <= i < at + len(phrase)}
        if len(keys) < len(phrase) or not phrase:
            raise ValueError(f"key phrase {key!r} is empty or holds function words")
        out.append((len(out), label, is_base, indexed, keys))
    return out


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """rid, doc_id, n_words, post (array of word and place) of every row."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(PLAIN_WORD), F.lit(0))
    post = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*vocabulary), F.struct(w.alias("w"), i.alias("p")))),
                    lambda x: x.isNotNull())
    return (docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).withColumn("words", words)
            .select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), post.alias("post")))


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM VALUES {', '.join(str(r) for r in rows)} AS t({names})"


def scan(docs: DataFrame, templates: list = TEMPLATES, base: list = BASE, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = _templates(templates, base)
    vocabulary = sorted({w for _, _, _, indexed, _ in known for w, _ in indexed})
    files = scratch.keep(postings(docs, vocabulary), "postings")
    counts = files.select(F.explode(F.array_distinct(F.transform("post", lambda x: x["w"]))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counts.collect()}           # at most one row per vocabulary word
    n = max(1, files.count())
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    rows, marks = [], set()
    for tid, _, _, indexed, keys in known:
        distinct = sorted({w for w, i in indexed if i in keys}, key=lambda w: (-idf[w], w))
        best = set(distinct[:anchors])
        marks |= best
        rows += [(tid, w, i, int(w in best), int(i in keys)) for w, i in indexed]
    names = [(tid, label, int(b), len(indexed), len(keys), min(2, len({w for w, i in indexed if i in keys}), anchors)) for tid, label, b, indexed, keys in known]
    index = F.broadcast(spark.sql(_values(rows, "tid, w, at, anchor, is_key")))     # configuration
    meta = F.broadcast(spark.sql(_values(names, "tid, label, base, n_indexed, n_keys, least_votes")))
    found = files.filter(F.exists("post", lambda x: x["w"].isin(*sorted(marks)))).select("rid", F.explode("post").alias("x"))
    hits = (found.select("rid", F.col("x.w").alias("w"), F.col("x.p").alias("p")).join(index, "w")
            .groupBy("rid", "tid", (F.col("p") - F.col("at")).alias("start"))
            .agg(F.count("*").alias("n"), F.sum("anchor").alias("votes"), F.sum("is_key").alias("keys"))
            .join(meta, "tid").filter("keys = n_keys AND votes >= least_votes"))
    is_base = F.col("base") == 1
    per = hits.groupBy("rid").agg(
        F.sum("base").alias("n_base"), F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(is_base, F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"),
        # a base phrase alone, without the sentence around it, counts half
        F.max(F.when(is_base, F.lit(0.5)).otherwise(F.col("n").cast("double") / F.col("n_indexed"))).alias("score"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return (files.select("rid", "doc_id", "n_words").join(per, "rid", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
                    joined("base_labels").alias("base_labels"), joined("labels").alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(templates: list = TEMPLATES, base: list = BASE) -> str:
    """The DuckDB statement: every phrase looked for at every place."""
    cols, labels, scores = [], [], []
    for tid, label, is_base, indexed, keys in _templates(templates, base):
        at = min(keys)
        phrase = [w for w, i in indexed if i in keys]
        same = " AND ".join(f"w[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase))
        cols.append(f"list_filter(range(0, len(w)), lambda i: coalesce({same}, false)) AS p{tid}")
        labels.append((tid, label, is_base))
        if not is_base:
            hits = " + ".join(f"(CASE WHEN i + {k - at} >= 0 AND w[greatest(i + {k - at + 1}, 1)] = '{w}' THEN 1 ELSE 0 END)" for w, k in indexed)
            scores.append(f"coalesce(list_max(list_transform(p{tid}, lambda i: ({hits}) / {len(indexed)})), 0)")
    found = lambda which: "list_filter([" + ", ".join(f"CASE WHEN len(p{t}) > 0 THEN '{la}' END" for t, la, b in labels if which(b)) + "], lambda x: x IS NOT NULL)"
    own = [f"p{t}" for t, _, b in labels if b]
    return f"""
WITH a AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN_WORD}') AS w FROM documents),
b AS (SELECT doc_id, w, {", ".join(cols)} FROM a),
c AS (SELECT *, flatten([{", ".join(own)}]) AS base_at FROM b)
SELECT doc_id, len(w) AS n_words, len(base_at) AS n_base, list_min(base_at) AS first_word, list_max(base_at) AS last_word,
  array_to_string(list_sort(list_distinct({found(lambda b: b)})), ',') AS base_labels,
  array_to_string(list_sort(list_distinct({found(lambda b: True)})), ',') AS labels,
  greatest({", ".join(scores)}, CASE WHEN len(base_at) > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM c
"""


OP7_SQL = _sql()
