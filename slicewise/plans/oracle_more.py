"""DuckDB statements for the index, QA-policy and score-ratio queries."""

from __future__ import annotations

from slicewise.plans.oracle import all_chunks_sql
from slicewise.plans.oracle_flagship import cosine_ctes
from slicewise.plans.oracle_metrics import ANSWER_PAIRS, ORACLE_METRICS
from slicewise.plans.oracle_replies import judge_ctes, qa_replies_ctes
from slicewise.plans.oracle_sources import QA_POOL_SQL

INDEX_UPSERT_SQL = """
WITH old AS (SELECT 'label_' || CAST(label AS VARCHAR) AS collection, vec_id AS chunk_id, label FROM embeddings)
SELECT collection, CAST(count(*) AS BIGINT) AS n_chunks,
       CAST(count(*) FILTER (WHERE label NOT IN (3, 7)) AS BIGINT) AS n_from_new,
       CAST(count(*) FILTER (WHERE label IN (3, 7)) AS BIGINT) AS n_rejected
FROM old GROUP BY collection"""

INDEX_VERSIONS_SQL = """
SELECT 'label_' || CAST(label AS VARCHAR) AS collection, CAST(count(*) AS BIGINT) AS n_before,
       CAST(count(*) FILTER (WHERE label <> 5) AS BIGINT) AS n_chunks,
       CAST(count(*) FILTER (WHERE label NOT IN (3, 5, 7)) AS BIGINT) AS n_from_new
FROM embeddings WHERE embedding IS NOT NULL GROUP BY label"""

INDEX_SKIP_SQL = f"""
WITH ch AS {all_chunks_sql()},
ex AS (SELECT collection, CAST(count(*) AS BIGINT) AS n FROM ch WHERE chunking_strategy = 'simple_chunk_100_overlap_10'
       GROUP BY collection)
SELECT c.collection, CASE WHEN ex.n IS NULL THEN 'index' ELSE 'skip' END AS action,
       coalesce(ex.n, 0) AS n_existing
FROM (SELECT DISTINCT collection FROM ch) c LEFT JOIN ex ON ex.collection = c.collection"""

QA_SKIP_SQL = f"""
WITH qa AS ({QA_POOL_SQL})
SELECT file_type FROM (SELECT DISTINCT source AS file_type FROM documents UNION SELECT 'rules_complex')
WHERE file_type NOT IN (SELECT DISTINCT file_type FROM qa)"""


def _policy_sql(policy: str) -> str:
    if policy == "append":
        both = "SELECT * FROM new_t UNION ALL SELECT * FROM old_t"
    else:
        both = ("SELECT * FROM new_t UNION ALL SELECT * FROM old_t "
                "WHERE file_type NOT IN (SELECT DISTINCT file_type FROM new_t)")
    return f"""
WITH {qa_replies_ctes()},
ex AS (SELECT conv_id, unnest(xs) AS item, generate_subscripts(xs, 1) - 1 AS qi FROM items),
new_t AS (SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) AS file_type, json_extract_string(item, '$.question') AS question,
                 json_extract_string(item, '$.answers[*]') AS answers, 0 AS src, conv_id * 4294967296 + qi AS pos FROM ex),
old_t AS (SELECT file_type, question, answers, 1 AS src, qa_id AS pos FROM qa),
both_t AS ({both})
SELECT file_type, CAST(row_number() OVER (PARTITION BY file_type ORDER BY src, pos) - 1 AS BIGINT) AS qa_order,
       question, array_to_string(answers, chr(31)) AS answers_text
FROM both_t"""


SCORE_RATIO_SQL = f"""
WITH {judge_ctes()},
acc AS (SELECT qa_id, arg_min(score, attempt) FILTER (WHERE valid) AS score FROM judged WHERE attempt < 3 GROUP BY qa_id),
{ANSWER_PAIRS.replace('qa AS (', 'qa2 AS (').replace('FROM qa)', 'FROM qa2)')},
{cosine_ctes('s', 'ap')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_type ORDER BY md5('seed0' || question), qa_id) AS sample_rank
           FROM qa),
m AS (SELECT q.file_type, q.qa_id, c.cosine_similarity, CAST(a.score AS DOUBLE) AS llm_score
      FROM ranked q JOIN scos c ON c.k = q.qa_id JOIN acc a ON a.qa_id = q.qa_id WHERE q.sample_rank <= 8)
SELECT file_type, CAST(count(*) AS BIGINT) AS n_questions,
       string_agg(printf('%.6f', cosine_similarity), ',' ORDER BY qa_id) AS cosine_similaritys,
       string_agg(coalesce(printf('%.0f', llm_score), 'null'), ',' ORDER BY qa_id) AS llm_evaluation_scores,
       round(sum(llm_score) / (2 * count(llm_score)), 6) AS llm_score_ratio
FROM m GROUP BY file_type"""

TEXT_FILES_SQL = """
SELECT source AS file_type, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, NULL::VARCHAR AS reason FROM documents GROUP BY source
UNION ALL SELECT 'rules_complex', NULL, 'text file not found'"""

FILE_STEMS_SQL = r"""
WITH p AS (SELECT DISTINCT url AS path FROM pages UNION SELECT 'data/' || source || '.txt' FROM documents UNION SELECT 'data/rules_complex.txt'),
b AS (SELECT path, CASE WHEN contains(path, '/') THEN list_extract(string_split(path, '/'), -1) ELSE path END AS base FROM p)
SELECT path, CASE WHEN base NOT LIKE '_%.%' THEN base
                  ELSE array_to_string(list_slice(string_split(base, '.'), 1, len(string_split(base, '.')) - 1), '.') END AS stem FROM b"""

QA_BY_STEM_SQL = f"""
WITH qa AS ({QA_POOL_SQL})
SELECT file_type, CAST(count(*) AS BIGINT) AS n_pairs, min(qa_id) AS first_qa FROM qa
WHERE file_type IN (SELECT source FROM documents) GROUP BY file_type"""

LONG_NAMES_SQL = f"""
WITH c AS (SELECT repeat('x', 60) AS collection, sha256(concat_ws(chr(1), repeat('x', 60) || file_type, chunking_strategy, 'run0')) AS collection_id,
                  doc_id, chunk_index FROM {all_chunks_sql()} a)
SELECT collection, collection_id, CAST(count(*) AS BIGINT) AS n_chunks,
       min(sha256(concat_ws(chr(1), collection_id, CAST(doc_id AS VARCHAR), CAST(chunk_index AS VARCHAR)))) AS first_id
FROM c GROUP BY ALL"""

UNION_SQL = f"""
SELECT qa_id, cosine_similarity, NULL::DOUBLE AS f1, 'cosine' AS kind FROM ({ORACLE_METRICS['answer_cosine']})
UNION ALL SELECT qa_id, NULL, f1, 'overlap' FROM ({ORACLE_METRICS['token_overlap']})"""

ORACLE_MORE = {
    "text_files_load": TEXT_FILES_SQL,
    "file_stems": FILE_STEMS_SQL,
    "qa_by_stem": QA_BY_STEM_SQL,
    "long_type_names": LONG_NAMES_SQL,
    "union_results": UNION_SQL,
    "index_upsert": INDEX_UPSERT_SQL,
    "index_versions": INDEX_VERSIONS_SQL,
    "index_skip_existing": INDEX_SKIP_SQL,
    "qa_skip": QA_SKIP_SQL,
    "qa_append": _policy_sql("append"),
    "qa_rebuild": _policy_sql("rebuild"),
    "score_ratio": SCORE_RATIO_SQL,
}
