"""DuckDB statements for the retrieval queries."""

from __future__ import annotations

from slicewise.operators.retrieval import PLANE_SQL

VECTORS = """
v AS (SELECT 'label_' || CAST(label AS VARCHAR) AS collection, vec_id AS chunk_id, vec_id AS chunk_index,
             label, embedding FROM embeddings),
ex AS (SELECT collection, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM v),
cen AS (SELECT collection, pos, round(avg(x::DOUBLE), 6) AS m FROM ex GROUP BY collection, pos),
q AS (SELECT collection, collection AS query_id, list(m ORDER BY pos) AS qv FROM cen GROUP BY collection)"""

# questions that are stored vectors themselves: every id divisible by 50
BY_ID = """
v AS (SELECT 'label_' || CAST(label AS VARCHAR) AS collection, vec_id AS chunk_id, vec_id AS chunk_index, label, embedding FROM embeddings),
q AS (SELECT collection, chunk_id AS query_id, embedding AS qv FROM v WHERE chunk_id % 50 = 0)"""

DIST = ("list_sum(list_transform(range(1, len(v.embedding) + 1), "
        "lambda i: (v.embedding[i]::DOUBLE - q.qv[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.qv[i]::DOUBLE)))")


def knn_sql(k: int | None, vectors: str = VECTORS) -> str:
    """The k nearest, or with None the whole collection."""
    return f"""
WITH {vectors},
d AS (SELECT q.query_id, v.collection, v.chunk_id, v.chunk_index, {DIST} AS distance
      FROM v JOIN q ON q.collection = v.collection),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index) AS rank FROM d)
SELECT query_id, collection, CAST(rank AS BIGINT) AS rank, chunk_id, chunk_index, round(distance, 6) AS distance
FROM r {'' if k is None else f'WHERE rank <= {k}'}"""


KNN_FILTERED_SQL = f"""
WITH {VECTORS},
d AS (SELECT q.query_id, 'all' AS collection, v.chunk_id, v.chunk_index, v.label, {DIST} AS distance
      FROM v JOIN q ON v.label = CAST(regexp_extract(q.query_id, '(\\d+)$', 1) AS INTEGER)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index) AS rank FROM d)
SELECT query_id, collection, CAST(rank AS BIGINT) AS rank, chunk_id, chunk_index, round(distance, 6) AS distance,
       CAST(label AS BIGINT) AS label
FROM r WHERE rank <= 8"""

HOLES = """
SELECT collection, chunk_id, chunk_index, label, CASE WHEN chunk_id % 7 = 0 THEN 'no vector'
       WHEN chunk_id % 11 = 0 THEN 'vector with a missing component'
       WHEN chunk_id % 13 = 0 THEN 'vector of another length' END AS reason, embedding FROM v"""

KNN_MIXED_SQL = f"""
WITH {VECTORS},
h AS ({HOLES}),
d AS (SELECT q.query_id, v.collection, v.chunk_id, v.chunk_index, v.label % 8 + 1 AS k, {DIST} AS distance
      FROM h v JOIN q ON q.collection = v.collection WHERE v.reason IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index) AS rank FROM d)
SELECT query_id, collection, CAST(rank AS BIGINT) AS rank, chunk_id, chunk_index, round(distance, 6) AS distance
FROM r WHERE rank <= k"""

KNN_UNSCORABLE_SQL = f"WITH {VECTORS}, h AS ({HOLES}) SELECT collection, chunk_id, reason FROM h WHERE reason IS NOT NULL"


def knn_lsh_sql(k: int = 8, tables: int = 4, bucket_length: float = 0.5, probes: int = 1, vectors: str = VECTORS) -> str:
    """Buckets by the same planes, summed in the same order."""
    w = PLANE_SQL.format(i="(i - 1)", t="t.t")
    dot = lambda v: (f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda i: {v}[i]::DOUBLE * ({w})::DOUBLE)), "  # noqa: E731
                     "lambda a, x: a + x)")
    return f"""
WITH {vectors},
t AS (SELECT unnest(range({tables})) AS t),
vb AS (SELECT v.collection, v.chunk_id, t.t, CAST(floor({dot('v.embedding')} / {bucket_length}) AS BIGINT) AS b FROM v CROSS JOIN t),
qb AS (SELECT q.collection, q.query_id, t.t, CAST(floor({dot('q.qv')} / {bucket_length}) AS BIGINT) AS b FROM q CROSS JOIN t),
near AS (SELECT DISTINCT qb.query_id, vb.chunk_id FROM vb JOIN qb ON vb.collection = qb.collection AND vb.t = qb.t AND abs(vb.b - qb.b) <= {probes}),
d AS (SELECT q.query_id, v.chunk_id, v.chunk_index, {DIST} AS distance FROM v JOIN q ON q.collection = v.collection),
ex8 AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index) AS r FROM d) WHERE r <= {k}),
ap8 AS (SELECT query_id, chunk_id FROM (
  SELECT d.*, row_number() OVER (PARTITION BY d.query_id ORDER BY distance, chunk_index) AS r
  FROM d JOIN near ON near.query_id = d.query_id AND near.chunk_id = d.chunk_id) WHERE r <= {k})
SELECT ex8.query_id, CAST(count(*) AS BIGINT) AS n_exact, CAST(count(ap8.chunk_id) AS BIGINT) AS n_found,
       round(count(ap8.chunk_id) / count(*), 6) AS recall_at_8
FROM ex8 LEFT JOIN ap8 ON ap8.query_id = ex8.query_id AND ap8.chunk_id = ex8.chunk_id GROUP BY ex8.query_id"""


# a search that goes on until it has k rows returns as many as the scan
INDEX_RECALL_SQL = f"""
WITH ranked AS ({knn_sql(8, BY_ID)})
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, count(*) AS n_returned, true AS recall_reached FROM ranked"""

ORACLE_RETRIEVAL = {
    "knn_mixed_k": KNN_MIXED_SQL,
    "knn_unscorable": KNN_UNSCORABLE_SQL,
    "knn_lsh": knn_lsh_sql(),
    "knn_exact_k8": knn_sql(8),
    "knn_k_exceeds_size": knn_sql(None),
    "knn_ids_k8": knn_sql(8, BY_ID),
    "index_ids_k8": knn_sql(8, BY_ID),
    "index_recall_ids_k8": INDEX_RECALL_SQL,
    "knn_ids_lsh": knn_lsh_sql(vectors=BY_ID),
    "knn_filtered": KNN_FILTERED_SQL,
}
