"""Blocked nearest rows: the same distances, ties and ranks as row by row, odd vectors, and no row per pair of rows."""

import numpy as np
from pyspark.sql import functions as F

from slicewise.operators import block_search
from slicewise.operators.retrieval import _buckets, knn, knn_lsh

SCHEMA = "collection string, chunk_id long, chunk_index long, embedding array<float>"
INF, NAN = float("inf"), float("nan")


def _distance(a, b):
    d = 0.0
    for x, y in zip(a, b):
        d += (x - y) * (x - y)
    return d


def _key(d, tie):
    return (d != d, 0.0 if d != d else d, tie)


def _rows(n, dims=5, seed=3):
    r = np.random.RandomState(seed)
    rows = [("a" if i % 3 else "b", i, i, [float(x) for x in r.normal(0, 1, dims).astype("float32")]) for i in range(n)]
    for i in range(7, n, 7):                                   # copies: equal distances, told apart by chunk_index
        rows[i] = (rows[i][0], i, i, rows[i - 7][3])
    return rows


def test_pairs_equal_a_scan_whatever_the_block_sizes(monkeypatch):
    r = np.random.RandomState(1)
    v = np.repeat(r.normal(0, 1, (40, 6)), 3, axis=0) + 1e6     # far from 0: products cancel
    v[5], v[6], v[7, 0], v[8] = np.inf, np.nan, 1e200, 1e200
    q = np.concatenate([v[::9], np.full((1, 6), 1e200), np.full((1, 6), np.inf)])
    k, order = np.arange(len(q)) % 7, r.permutation(len(v))
    want = {(i, j) for i in range(len(q)) for j in sorted(range(len(v)), key=lambda j: _key(_distance(v[j], q[i]), order[j]))[:k[i]]}
    for pairs in (1, 300, 1 << 20):
        monkeypatch.setattr(block_search, "PAIRS", pairs)
        with np.errstate(all="ignore"):
            i, j, d = block_search.nearest_pairs(v, q, k, order)
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
        assert all(x == _distance(v[b], q[a]) or x != x for a, b, x in zip(i, j, d))


def test_knn_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(block_search, "BLOCK_ROWS", 8)
    monkeypatch.setattr(block_search, "QUESTION_ROWS", 3)
    rows = _rows(120)
    odd = [("a", 900, 900, None), ("a", 901, 901, [None] + [0.0] * 4), ("a", 902, 902, [0.0] * 4), ("a", 903, 903, [NAN] * 5),
           ("a", 904, 904, [INF] * 5), (None, 905, 905, [0.0] * 5)]
    asked = [r for r in rows if r[1] % 10 == 0]
    queries = spark.createDataFrame([(f"q{r[1]}", r[0], r[3], r[1] % 4 + 1) for r in asked] + [("n", "a", None, 3), ("z", "a", [0.0] * 5, None)],
                                    "query_id string, collection string, query_vector array<float>, k int")
    vectors = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    want = {}
    for r in asked:
        near = sorted((_key(_distance(x[3], r[3]), x[2]) for x in rows if x[0] == r[0]))[:r[1] % 4 + 1]
        want[f"q{r[1]}"] = [(rank + 1, t, d) for rank, (_, d, t) in enumerate(near)]
    for dims in (5, None):
        got = {}
        for h in knn(queries, vectors, "k", dims=dims).orderBy("query_id", "rank").collect():
            got.setdefault(h.query_id, []).append((h["rank"], h.chunk_id, h.distance))
        assert got == want
    nan_last = knn(queries.filter("query_id = 'q10'").withColumn("k", F.lit(200)), vectors, "k", dims=5).orderBy("rank").collect()
    assert [h.chunk_id for h in nan_last[-2:]] == [904, 903]


def test_lsh_scores_each_candidate_once(spark):
    rows = _rows(150)
    vectors = spark.createDataFrame(rows, SCHEMA)
    queries = vectors.filter("chunk_id % 10 = 0").select("collection", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    buckets = {r.chunk_id: [b.bucket for b in r.h] for r in vectors.select("chunk_id", _buckets("embedding", 5, 4, 0.5).alias("h")).collect()}
    want = set()
    for c, i, _, x in rows:
        if i % 10 == 0:
            shared = [(_distance(y, x), j) for d, j, _, y in rows if d == c and any(abs(a - b) <= 1 for a, b in zip(buckets[i], buckets[j]))]
            want |= {(i, j, rank + 1) for rank, (_, j) in enumerate(sorted(shared)[:8])}
    got = knn_lsh(queries, vectors, 8, 5).collect()
    assert {(h.query_id, h.chunk_id, h["rank"]) for h in got} == want and len(got) == len(want)


def test_search_makes_no_row_per_pair(spark):
    """Before, the join of 2,000 vectors with 200 questions had 400,000 rows, each with both vectors."""
    rows = [("a", i, i, [float(i % 13), float(i % 7)]) for i in range(2000)]
    vectors = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    queries = vectors.filter("chunk_id % 10 = 0").select("collection", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    asked = queries.withColumnRenamed("collection", "_c").withColumn("_k", F.lit(2).cast("long"))
    pairs = block_search.nearest(vectors, asked, [("collection", "_c")], "_k", ["chunk_index"])
    assert pairs.count() == 200 * 2
    assert "Join" in pairs._jdf.queryExecution().optimizedPlan().toString()
    plan = knn(queries, vectors, 2, dims=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")        # top rows are chosen from joined blocks, not from joined rows
