"""Rerank (T4), rerank index -> hit (J4), rerank response envelope.

Second-stage order of the k hits of every question, keeping `top_n` (all when
top_n is null). No hits -> nothing; an empty question -> the hits unchanged;
a question the scorer returns nothing for -> the unreranked hits. Scores come
from the built-in lexical scorer (TF-IDF cosine of question and chunk) or
from a table of rerank responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewise.functions.replies import one_json
from slicewise.operators.similarity import text_pair_cosine

RERANK_RESULTS = "array<struct<index: bigint, relevance_score: double>>"


def parse_rerank_response(responses: DataFrame, query_key: str = "query_id", body_col: str = "body") -> DataFrame:
    """(query_key, body) -> (query_key, position, index, relevance_score); bad JSON -> no rows."""
    results = F.try_variant_get(one_json(F.col(body_col)), "$.results", RERANK_RESULTS)
    return responses.select(query_key, F.posexplode(results).alias("position", "res")).select(
        query_key, F.col("position").cast("long"), F.col("res.index").alias("index"),
        F.col("res.relevance_score").alias("relevance_score"))


def lexical_scores(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Built-in scorer: (query_key, rank, score) from TF-IDF cosine of question and chunk text."""
    keyed = hits.withColumn("_hk", F.concat_ws("#", F.col(query_key).cast("string"), F.col("rank").cast("string")))
    cos = text_pair_cosine(keyed.select("_hk", "question", "chunk_text"), "_hk", "question", "chunk_text")
    return keyed.select(query_key, "rank", "_hk").join(cos, "_hk").select(
        query_key, "rank", F.col("cosine_similarity").alias("score"))


def rerank(hits: DataFrame, top_n_col: str = "reranker_top_n", query_key: str = "query_id",
           scores: DataFrame | None = None) -> DataFrame:
    """hits: query_key, rank (1-based), question, chunk_text, top_n column, ...

    scores: (query_key, rank, score) or None for the lexical scorer.
    Output: the hit columns plus rerank_rank (1-based) and score; only kept rows.
    """
    if scores is None:
        scores = lexical_scores(hits, query_key)
    empty = F.col("question").isNull() | (F.col("question") == "")
    scored = hits.join(scores, [query_key, "rank"], "left")
    has_scores = scored.groupBy(query_key).agg(F.count("score").alias("_scored"))
    scored = scored.join(has_scores, query_key)
    # unchanged order (and no cut) for empty questions and for questions without scores
    passthrough = empty | (F.col("_scored") == 0)
    # scores are compared at 12 decimals: equal scores summed in another order still tie (then by rank)
    order_key = F.when(passthrough, F.lit(None).cast("double")).otherwise(F.round(F.col("score"), 12))
    w = Window.partitionBy(query_key).orderBy(F.desc_nulls_last(order_key), F.col("rank"))
    # a scorer that lists some hits of a question leaves the others out
    ranked = scored.filter(passthrough | F.col("score").isNotNull()).withColumn("rerank_rank", F.row_number().over(w))
    keep = passthrough | F.col(top_n_col).isNull() | (F.col("rerank_rank") <= F.col(top_n_col))
    return ranked.filter(keep).drop("_scored")


def scores_from_results(results: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Rerank results (index = 0-based position among the hits) -> (query_key, rank, score).

    Results are sorted by relevance, so the score is the negated position.
    """
    return results.select(query_key, (F.col("index") + 1).alias("rank"),
                          (-F.col("position")).cast("double").alias("score"))
