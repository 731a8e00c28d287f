"""DuckDB statements for the metric queries."""

from __future__ import annotations

from slicewise.plans.oracle import all_chunks_sql
from slicewise.plans.oracle_sources import QA_POOL_SQL

TOKENS = r"regexp_extract_all(lower({x}), '([\p{{L}}\p{{N}}_]{{2,}})', 1)"
IDF_ONE = "(ln(1.5) + 1.0)"


def tokens(x: str) -> str:
    return TOKENS.format(x=x)


def cosine_ctes(pairs: str, key: str = "k") -> str:
    """cos(k, cosine_similarity) for a relation `pairs`(k, a, b) of two texts per key."""
    return f"""
ta AS (SELECT {key} AS k, unnest({tokens('a')}) AS token FROM {pairs}),
tb AS (SELECT {key} AS k, unnest({tokens('b')}) AS token FROM {pairs}),
ca AS (SELECT k, token, count(*)::DOUBLE AS fa FROM ta GROUP BY k, token),
cb AS (SELECT k, token, count(*)::DOUBLE AS fb FROM tb GROUP BY k, token),
tj AS (SELECT coalesce(ca.k, cb.k) AS k, coalesce(fa, 0) AS fa, coalesce(fb, 0) AS fb,
              CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN 1.0 ELSE {IDF_ONE} END AS idf
       FROM ca FULL OUTER JOIN cb ON ca.k = cb.k AND ca.token = cb.token),
ts AS (SELECT k, sum(fa * fb * idf * idf) AS dot, sum(fa * fa * idf * idf) AS na, sum(fb * fb * idf * idf) AS nb
       FROM tj GROUP BY k),
cos AS (SELECT p.{key} AS k, CASE WHEN na > 0 AND nb > 0 THEN dot / sqrt(na * nb) ELSE 0.0 END AS cosine_similarity
        FROM {pairs} p LEFT JOIN ts ON ts.k = p.{key})"""


ANSWER_PAIRS = f"""
qa AS ({QA_POOL_SQL}),
ap AS (SELECT qa_id AS k, array_to_string(answers, chr(10)) AS a, question AS b FROM qa)"""

ANSWER_COSINE_SQL = f"""
WITH {ANSWER_PAIRS}, {cosine_ctes('ap')}
SELECT k AS qa_id, round(cosine_similarity, 6) AS cosine_similarity FROM cos"""

TOKEN_OVERLAP_SQL = f"""
WITH {ANSWER_PAIRS},
sets AS (SELECT k, list_distinct({tokens('a')}) AS sa, list_distinct({tokens('b')}) AS sb FROM ap),
sz AS (SELECT k, CAST(len(list_intersect(sa, sb)) AS DOUBLE) AS i, CAST(len(sa) AS DOUBLE) AS na,
              CAST(len(sb) AS DOUBLE) AS nb, CAST(len(list_distinct(list_concat(sa, sb))) AS DOUBLE) AS u FROM sets),
pr AS (SELECT k, CASE WHEN nb > 0 THEN i / nb ELSE 0.0 END AS p, CASE WHEN na > 0 THEN i / na ELSE 0.0 END AS r,
              CASE WHEN u > 0 THEN i / u ELSE 0.0 END AS j FROM sz)
SELECT k AS qa_id, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round(j, 6) AS jaccard
FROM pr"""

CHUNK_VS_ORIGINAL_SQL = f"""
WITH ch AS (SELECT * FROM {all_chunks_sql()} x),
pairs AS (SELECT ch.collection || '/' || CAST(ch.doc_id AS VARCHAR) || '/' || CAST(ch.chunk_index AS VARCHAR) AS k,
                 ch.collection, ch.chunk_text AS a, d.text AS b
          FROM ch JOIN documents d ON d.doc_id = ch.doc_id),
{cosine_ctes('pairs')}
SELECT p.collection, CAST(count(*) AS BIGINT) AS n_chunks, round(avg(c.cosine_similarity), 6) AS mean_cosine
FROM pairs p JOIN cos c ON c.k = p.k GROUP BY p.collection"""

ORACLE_METRICS = {
    "answer_cosine": ANSWER_COSINE_SQL,
    "token_overlap": TOKEN_OVERLAP_SQL,
    "chunk_vs_original_cosine": CHUNK_VS_ORIGINAL_SQL,
}
