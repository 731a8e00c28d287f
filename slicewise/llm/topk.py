"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into shards of about `SHARD` by hash. A shard keeps, per
dimension, its vectors' places in ascending order: the sorted list, read from
the top for positive query weights and from the bottom for negative ones. A query
reads all its lists in parallel, a stretch at a time; every vector met for the first
time is scored in full, and the search in a shard stops once the threshold (the
best score that a vector not yet met could have, from the values last read) is below
the k-th score so far. Ties need the strict comparison: a vector not yet met
may equal the k-th score with a smaller id. The shards' k best are then merged.

Queries meet shards as blocks: a block of `BLOCK` queries and one shard share a task,
so memory is bounded by both, whatever the tables' sizes, and no pair of rows is
shuffled or emitted.

Components are floor(256 * x) with x as double, so scores are exact integers.

Defined cases: vectors that are null or empty or hold a null, NaN or infinity
take no part; vectors of different lengths have no score together; rows repeating
an id and its vector count once, and a query never meets rows of its own id; two
different vectors under one id stand each for itself; fewer than k
candidates: all of them; null ids take no part; empty table: empty result; ties go to the
smaller vec_id; only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARD = 8192
BLOCK = 512
STRETCH = 32

_PARTIAL = "query_id long, qn long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<long>), dim; only vectors that take part, repeats once."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    # `forall` is null if a component is null
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))
            .select("vec_id", v.alias("v"), F.size("embedding").alias("dim")).distinct())


def threshold_search(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, query_id: int, query: np.ndarray,
                     k: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, int]:
    """ids and scores of the k best of one shard, and the depth read. lists: per dimension (row) places by ascending value."""
    n = len(ids)
    met = ids == query_id
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    dims = np.flatnonzero(query)                       # a zero weight adds nothing anywhere
    up = query[dims] > 0
    depth = 0
    while depth < n:
        nxt = min(n, depth + stretch)
        rows = np.where(up[:, None], lists[dims, n - nxt:n - depth][:, ::-1], lists[dims, depth:nxt]) if len(dims) else np.arange(n)[None, :]
        new = np.zeros(n, dtype=bool)
        new[rows] = True
        new &= ~met
        met |= new
        places = np.flatnonzero(new)
        if len(places):
            all_ids = np.concatenate([best_ids, ids[places]])
            scores = np.concatenate([best, vectors[places] @ query])
            order = np.lexsort((all_ids, -scores))[:k]
            best_ids, best = all_ids[order], scores[order]
        depth = nxt if len(dims) else n
        if len(best) == k:
            last = vectors[rows[:, -1], dims] if len(dims) else np.zeros(0)
            if float(last @ query[dims]) < best[-1]:
                break
        stretch *= 2
    return best_ids, best, depth


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; both frames have vec_id and embedding."""
    base, asked = quantised(vectors), quantised(queries)
    n, m = base.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = (base.withColumn("s", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("b", every(blocks)))
    # two vectors under one query id are two queries, told apart by qn
    asked = asked.withColumn("qn", F.xxhash64("v"))
    right = asked.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("s", every(shards))

    def search(key, cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cand) and len(ask):
            ids = cand["vec_id"].to_numpy()
            matrix = np.array(cand["v"].tolist(), dtype=np.float64)       # integers below 2^53: exact
            lists = np.argsort(matrix, axis=0, kind="stable").T.copy()
            for q, qn, v in zip(ask["vec_id"], ask["qn"], ask["v"], strict=True):
                got, scores, _ = threshold_search(ids, matrix, lists, q, np.array(v, dtype=np.float64), k)
                out.append(pd.DataFrame({"query_id": q, "qn": qn, "vec_id": got, "score": scores.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "qn": [], "vec_id": [], "score": []}).astype("int64")

    keys = ["dim", "s", "b"]
    found = (left.groupBy(*keys).cogroup(right.select("vec_id", "qn", "v", *keys).groupBy(*keys)).applyInPandas(search, _PARTIAL))
    rank = F.row_number().over(Window.partitionBy("query_id", "qn").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
