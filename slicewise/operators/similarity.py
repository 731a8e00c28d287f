"""Text similarity metrics.

A1 is the TF-IDF cosine of two texts with the vectoriser fitted on just those
two texts: lower-cased tokens of two or more word characters, raw counts,
smoothed idf ln((1+n)/(1+df))+1 with n = 2, L2 norm. A token in both texts
weighs 1, a token in one text ln(1.5)+1. Empty vocabulary or an empty side
gives 0.0.

Plan: token counts are pre-aggregated per (text, token) before any shuffle.
Pairs are scored by joining the left side's counts to the right side's counts
on (right text, token). A right text shared by many pairs (a document and its
chunks) is never replicated per pair: its norm splits into a per-text total
and a correction over the shared tokens, which the join already has.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise.functions.text import tokens
from slicewise.operators import chunking
from slicewise.operators.shared_tokens import DocumentTokens, LastTokens, walked, within

# Idf of a token present in one of the two texts / in both.
IDF_ONE = math.log(1.5) + 1.0
IDF_BOTH = 1.0


def token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n): token counts per text, aggregated map-side before the shuffle."""
    return (df.select(F.col(id_col).alias("_id"), F.explode(tokens(F.col(text_col))).alias("token"))
              .groupBy("_id", "token").agg(F.count("*").cast("double").alias("n"))
              .withColumnRenamed("_id", id_col))


def pair_cosine(pairs: DataFrame, key: str, left_id: str, right_id: str,
                left_counts: DataFrame, right_counts: DataFrame) -> DataFrame:
    """A1 over many pairs: (key, left_id, right_id) -> (key, cosine_similarity).

    left_counts: (left_id, token, n); right_counts: (right_id, token, n).
    """
    i2 = IDF_ONE * IDF_ONE
    lc = left_counts.select(F.col(left_id), "token", F.col("n").alias("fa"))
    rc = right_counts.select(F.col(right_id), "token", F.col("n").alias("fb"))
    left = pairs.select(key, left_id, right_id).join(lc, left_id)
    both = left.join(rc, [right_id, "token"], "left")
    per_key = both.groupBy(key).agg(
        F.sum(F.coalesce(F.col("fa") * F.col("fb"), F.lit(0.0))).alias("dot"),
        F.sum(F.when(F.col("fb").isNull(), F.col("fa") * F.col("fa") * i2)
               .otherwise(F.col("fa") * F.col("fa"))).alias("na"),
        F.sum(F.coalesce(F.col("fb") * F.col("fb"), F.lit(0.0))).alias("shared_fb2"))
    right_total = rc.groupBy(right_id).agg(F.sum(F.col("fb") * F.col("fb")).alias("sb"))
    scored = (pairs.select(key, right_id).join(per_key, key, "left").join(right_total, right_id, "left"))
    nb = F.lit(i2) * F.coalesce(F.col("sb"), F.lit(0.0)) + F.lit(1.0 - i2) * F.coalesce(F.col("shared_fb2"), F.lit(0.0))
    na = F.coalesce(F.col("na"), F.lit(0.0))
    cos = F.when((na > 0) & (nb > 0), F.coalesce(F.col("dot"), F.lit(0.0)) / F.sqrt(na * nb)).otherwise(F.lit(0.0))
    return scored.select(key, cos.alias("cosine_similarity"))


def chunk_document_cosine(chunks: DataFrame, docs: DataFrame, chunk_keys: list[str],
                          doc_key: str = "doc_id") -> DataFrame:
    """A11 for chunk rows apart from their documents (such as retrieved ones); `pair_chunk_cosines`
    scores the chunks of a whole corpus without a shuffle. Chunks are read once.

    chunks: chunk_keys (including doc_key) + chunk_text; docs: doc_key + text.
    Token counts are aggregated per (chunk, token) and per (document, token);
    the document norm is a per-document total corrected over the tokens the
    chunk shares, so a document is never copied per chunk. Chunks without a
    token are kept (explode_outer) and score 0.
    Output: chunk_keys + cosine_similarity.
    """
    i2 = IDF_ONE * IDF_ONE
    # Chunk token occurrences are hash-partitioned by (document, token) once: that layout serves
    # both the per-(chunk, token) count and the join with the document's counts (which are
    # grouped by exactly those keys), so the join adds no second exchange of the chunk side.
    # Tokens repeat little inside a short chunk, so the lost map-side combine costs little.
    ct = (chunks.select(*chunk_keys, F.explode_outer(tokens(F.col("chunk_text"))).alias("token"))
          .repartition(doc_key, "token")
          .groupBy(*chunk_keys, "token").agg(F.count("token").cast("double").alias("fa")))
    dt = (docs.select(doc_key, F.explode(tokens(F.col("text"))).alias("token"))
          .groupBy(doc_key, "token").agg(F.count("*").cast("double").alias("fb")))
    per_chunk = (ct.join(dt, [doc_key, "token"], "left").groupBy(*chunk_keys).agg(
        F.sum(F.coalesce(F.col("fa") * F.col("fb"), F.lit(0.0))).alias("dot"),
        F.sum(F.when(F.col("fb").isNull(), F.col("fa") * F.col("fa") * i2)
               .otherwise(F.col("fa") * F.col("fa"))).alias("na"),
        F.sum(F.coalesce(F.col("fb") * F.col("fb"), F.lit(0.0))).alias("shared")))
    totals = dt.groupBy(doc_key).agg(F.sum(F.col("fb") * F.col("fb")).alias("sb"))
    nb = F.lit(i2) * F.coalesce(F.col("sb"), F.lit(0.0)) + F.lit(1.0 - i2) * F.col("shared")
    cos = F.when((F.col("na") > 0) & (nb > 0), F.col("dot") / F.sqrt(F.col("na") * nb)).otherwise(F.lit(0.0))
    return per_chunk.join(totals, doc_key, "left").select(*chunk_keys, cos.alias("cosine_similarity"))


def span_cosines(document: DocumentTokens, cut: DocumentTokens, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A11 of ranges of the text `cut` with the whole text `document` (the same one, unless a splitter drops characters)."""
    i2, v = IDF_ONE * IDF_ONE, len(cut.ids)
    in_document = (document.counts if cut is document else
                   np.array([document.counts[document.ids[t]] if t in document.ids else 0 for t in cut.ids], dtype=np.int64))
    first, after, words = cut.spans(begin, end)
    row, at = within(first, after)
    keys = row * v + cut.tokens[at]                                        # (range, id) of every whole word
    cut_known = [k * v + cut.ids[w] for k, w in words if w in cut.ids]     # and of parts of words that are words themselves
    keys, n = np.unique(np.concatenate((keys, np.array(cut_known, dtype=np.int64))), return_counts=True)
    row, m = (keys // v, in_document[keys % v]) if v else (keys, keys)
    others = Counter((k, w) for k, w in words if w not in cut.ids)
    if others:
        row = np.concatenate((row, [k for k, _ in others]))
        n = np.concatenate((n, list(others.values())))
        m = np.concatenate((m, [document.counts[document.ids[w]] if w in document.ids else 0 for _, w in others]))

    def per_range(x):
        return np.bincount(row, weights=x, minlength=len(begin))

    dot, na = per_range(n * m), per_range(np.where(m > 0, 1.0, i2) * n * n)
    nb = i2 * int((document.counts * document.counts).sum()) + (1.0 - i2) * per_range(m * m)
    some = (na > 0) & (nb > 0)
    return np.divide(dot, np.sqrt(np.where(some, na * nb, 1.0)), out=np.zeros(len(begin)), where=some)


def _walk_with_cosines(shapes: list):
    def run(texts: pa.Array, shape: pa.Array, pieces: pa.Array, leaves: pa.Array, size: pa.Array, overlap: pa.Array) -> pa.Array:
        documents, cuts, out, at = LastTokens(), LastTokens(), [np.zeros(0)], [0]
        for row in walked(shapes, texts, shape, pieces, leaves, size, overlap):
            if row is not None:
                text, base, _, begin, end = row
                document = documents.of(text)
                out.append(span_cosines(document, document if base == text else cuts.of(base), begin, end))
            at.append(at[-1] + (len(out[-1]) if row is not None else 0))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(out)))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType())).asNondeterministic()       # run once, not copied into filters on its result


def pair_chunk_cosines(pairs: DataFrame, strategies_rows: list, text_col: str = "text",
                       size_col: str = "chunk_size", overlap_col: str = "chunk_overlap") -> DataFrame:
    """A11 inside a document's row: the input columns and `cosines`, one per chunk of `chunking.pair_chunk_lists`.

    No chunk text is built and no token row shuffled: the walk's ranges are counted over the
    document's tokens, which are found once for all its strategies.
    """
    rows, shapes = chunking.pair_shapes(pairs, strategies_rows, text_col, size_col)
    scores = _walk_with_cosines(shapes)(*chunking.walk_columns(rows, text_col, size_col, overlap_col))
    return rows.select(*pairs.columns, scores.alias("cosines"))


def text_pair_cosine(df: DataFrame, key: str, text_a: str, text_b: str) -> DataFrame:
    """A1 where each row carries both texts: (key, text_a, text_b) -> (key, cosine_similarity)."""
    a = token_counts(df.select(F.col(key).alias("_l"), text_a), "_l", text_a)
    b = token_counts(df.select(F.col(key).alias("_r"), text_b), "_r", text_b)
    pairs = df.select(key, F.col(key).alias("_l"), F.col(key).alias("_r"))
    return pair_cosine(pairs, key, "_l", "_r", a, b)


def joined_answers(answers: Column) -> Column:
    """Several standard answers -> one reference text."""
    return F.array_join(answers, "\n")


def token_overlap(text_a: Column, text_b: Column) -> Column:
    """Precision / recall / F1 / Jaccard of distinct token sets (b measured against a)."""
    ta = F.array_distinct(tokens(text_a))
    tb = F.array_distinct(tokens(text_b))
    inter = F.size(F.array_intersect(ta, tb)).cast("double")
    union = F.size(F.array_union(ta, tb)).cast("double")
    na, nb = F.size(ta).cast("double"), F.size(tb).cast("double")
    precision = F.when(nb > 0, inter / nb).otherwise(0.0)
    recall = F.when(na > 0, inter / na).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    jaccard = F.when(union > 0, inter / union).otherwise(0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), jaccard.alias("jaccard"))
