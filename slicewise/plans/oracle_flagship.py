"""DuckDB statements for retrieval, rerank, context, prompt and the flagship summary.

Vectors, norms and distances are reduced sequentially (list_reduce from 0.0),
in the same order as Spark's `aggregate`, so distances agree bit for bit and
the top-k order (ties by chunk_id) is the same. Rerank scores are ordered
after rounding to 12 places so that equal scores summed in another order
still tie.
"""

from __future__ import annotations

from slicewise.operators.prompts import DEFAULT_TEMPLATES
from slicewise.plans.oracle import all_chunks_sql, experiments_ctes
from slicewise.plans.oracle_metrics import IDF_ONE, tokens
from slicewise.plans.oracle_sources import qa_sample_ctes

DIMS = 64
RAG_TEMPLATE = dict(DEFAULT_TEMPLATES)["RAGAnswer"]


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lexvec_ctes(prefix: str, src: str, id_col: str, text_col: str) -> str:
    """{prefix}vec(id, emb): hashed term-frequency vectors, L2-normalised."""
    p = prefix
    return f"""
{p}tok AS (SELECT {id_col} AS id, unnest({tokens(text_col)}) AS t FROM {src}),
{p}bk AS (SELECT id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIMS} AS INTEGER) AS b, count(*)::DOUBLE AS n
          FROM {p}tok GROUP BY id, b),
{p}ids AS (SELECT DISTINCT {id_col} AS id FROM {src}),
{p}dense AS (SELECT i.id, list(coalesce(k.n, 0.0::DOUBLE) ORDER BY d.d) AS v
             FROM {p}ids i CROSS JOIN range({DIMS}) d(d) LEFT JOIN {p}bk k ON k.id = i.id AND k.b = d.d GROUP BY i.id),
{p}nrm AS (SELECT id, v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, v), lambda a, x: a + x * x)) AS nrm FROM {p}dense),
{p}vec AS (SELECT id, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS emb FROM {p}nrm)"""


def cosine_ctes(prefix: str, pairs: str) -> str:
    """{prefix}cos(k, cosine_similarity) for `pairs`(k, a, b)."""
    p = prefix
    return f"""
{p}ta AS (SELECT k, unnest({tokens('a')}) AS token FROM {pairs}),
{p}tb AS (SELECT k, unnest({tokens('b')}) AS token FROM {pairs}),
{p}ca AS (SELECT k, token, count(*)::DOUBLE AS fa FROM {p}ta GROUP BY k, token),
{p}cb AS (SELECT k, token, count(*)::DOUBLE AS fb FROM {p}tb GROUP BY k, token),
{p}tj AS (SELECT coalesce(x.k, y.k) AS k, coalesce(fa, 0) AS fa, coalesce(fb, 0) AS fb,
                 CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN 1.0 ELSE {IDF_ONE} END AS idf
          FROM {p}ca x FULL OUTER JOIN {p}cb y ON x.k = y.k AND x.token = y.token),
{p}ts AS (SELECT k, sum(fa * fb * idf * idf) AS dot, sum(fa * fa * idf * idf) AS na, sum(fb * fb * idf * idf) AS nb
          FROM {p}tj GROUP BY k),
{p}cos AS (SELECT q.k, CASE WHEN na > 0 AND nb > 0 THEN dot / sqrt(na * nb) ELSE 0.0 END AS cosine_similarity
           FROM {pairs} q LEFT JOIN {p}ts s ON s.k = q.k)"""


def recall_sql(a: str, b: str) -> str:
    """Share of the distinct tokens of a that occur in b (0 when a has none)."""
    sa, sb = f"list_distinct({tokens(a)})", f"list_distinct({tokens(b)})"
    return (f"(CASE WHEN len({sa}) > 0 THEN CAST(len(list_intersect({sa}, {sb})) AS DOUBLE) / len({sa}) "
            f"ELSE 0.0 END)")


def retrieval_ctes() -> str:
    return f"""
{experiments_ctes()},
ch AS {all_chunks_sql()},
ch2 AS (SELECT *, sha256(concat_ws(chr(1), collection_id, CAST(doc_id AS VARCHAR), CAST(chunk_index AS VARCHAR)))
               AS chunk_id FROM ch),
{lexvec_ctes('c', 'ch2', 'chunk_id', 'chunk_text')},
{qa_sample_ctes()},
questions AS (
  SELECT e.experiment_id || '|' || CAST(s.qa_id AS VARCHAR) AS query_id, e.experiment_id, s.file_type, e.collection,
         e.retrieval_n_results AS k, e.rerank, e.reranker_top_n, s.qa_id, s.question,
         array_to_string(s.answers, chr(10)) AS std_text
  FROM sampled s JOIN exps e ON e.file_type = s.file_type WHERE e.reason IS NULL AND e.method <> 'outside'),
{lexvec_ctes('q', 'questions', 'query_id', 'question')},
dist AS (
  SELECT q.query_id, q.collection, c2.chunk_id, q.k,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, {DIMS} + 1),
                     lambda i: (cv.emb[i] - qv.emb[i]) * (cv.emb[i] - qv.emb[i]))), lambda a, x: a + x) AS distance
  FROM questions q JOIN qvec qv ON qv.id = q.query_id
  JOIN ch2 c2 ON c2.collection = q.collection JOIN cvec cv ON cv.id = c2.chunk_id),
ranked_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM dist),
hits AS (
  SELECT h.query_id, h.collection, h.chunk_id, h.rank, h.distance, c2.chunk_text, c2.doc_id,
         q.question, q.rerank, q.reranker_top_n
  FROM ranked_hits h JOIN ch2 c2 ON c2.chunk_id = h.chunk_id JOIN questions q ON q.query_id = h.query_id
  WHERE h.rank <= h.k),
rpairs AS (SELECT query_id || '#' || CAST(rank AS VARCHAR) AS k, question AS a, chunk_text AS b FROM hits WHERE rerank),
{cosine_ctes('r', 'rpairs')},
rscored AS (
  SELECT h.*, s.cosine_similarity AS score,
         row_number() OVER (PARTITION BY h.query_id ORDER BY round(s.cosine_similarity, 12) DESC, h.rank) AS rerank_rank
  FROM hits h JOIN rcos s ON s.k = h.query_id || '#' || CAST(h.rank AS VARCHAR) WHERE h.rerank),
kept AS (
  SELECT query_id, chunk_id, rank, rerank_rank, score, chunk_text, rerank FROM rscored
  WHERE trim(question) = '' OR reranker_top_n IS NULL OR rerank_rank <= reranker_top_n
  UNION ALL
  SELECT query_id, chunk_id, rank, rank AS rerank_rank, NULL AS score, chunk_text, rerank FROM hits WHERE NOT rerank),
ctx0 AS (SELECT query_id, list(chunk_text ORDER BY rerank_rank) AS context, count(*) AS kept_count
         FROM kept GROUP BY query_id),
retr AS (SELECT query_id, count(*) AS retrieved_count FROM hits GROUP BY query_id),
ctx AS (
  SELECT q.*, CASE WHEN q.question IS NULL OR q.question = '' THEN 'no question'
                   WHEN c.context IS NULL THEN 'no documents' ELSE 'ok' END AS status,
         CASE WHEN q.question IS NULL OR q.question = '' OR c.context IS NULL THEN []::VARCHAR[] ELSE c.context END
           AS context,
         CASE WHEN q.question IS NULL OR q.question = '' OR c.context IS NULL THEN 0 ELSE r.retrieved_count END
           AS retrieved_count,
         CASE WHEN q.question IS NOT NULL AND q.question <> '' AND c.context IS NOT NULL AND q.rerank
              THEN c.kept_count ELSE 0 END AS reranked_count,
         CASE WHEN q.question IS NULL OR q.question = '' THEN 'Error: No question provided.'
              WHEN c.context IS NULL THEN 'Could not retrieve relevant documents to answer the question.' END
           AS guard_answer
  FROM questions q LEFT JOIN ctx0 c ON c.query_id = q.query_id LEFT JOIN retr r ON r.query_id = q.query_id),
prompts AS (
  SELECT *, replace(replace({_lit(RAG_TEMPLATE)}, '{{question}}', question), '{{document}}',
                    array_to_string(context, chr(10))) AS full_prompt
  FROM ctx)"""


def retrieve_sql() -> str:
    return f"""WITH RECURSIVE {retrieval_ctes()}
SELECT query_id, collection, chunk_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM hits"""


def rerank_sql() -> str:
    return f"""WITH RECURSIVE {retrieval_ctes()}
SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, CAST(rerank_rank AS BIGINT) AS rerank_rank,
       round(score, 6) AS score FROM kept WHERE rerank"""


def context_sql() -> str:
    return f"""WITH RECURSIVE {retrieval_ctes()}
SELECT query_id, CAST(len(context) AS BIGINT) AS n_context, CAST(retrieved_count AS BIGINT) AS retrieved_count,
       CAST(reranked_count AS BIGINT) AS reranked_count, status, md5(array_to_string(context, chr(31))) AS context_md5
FROM ctx"""


def prompt_sql() -> str:
    return f"""WITH RECURSIVE {retrieval_ctes()}
SELECT query_id, CAST(length(substring(full_prompt, 1, 8192)) AS BIGINT) AS prompt_chars,
       length(full_prompt) > 8192 AS truncated, md5(substring(full_prompt, 1, 8192)) AS prompt_md5
FROM prompts"""


def rerank_fallback_sql() -> str:
    return f"""WITH RECURSIVE {retrieval_ctes()},
items AS (
  SELECT query_id, CAST(split_part(query_id, '|', 2) AS BIGINT) AS qa_id,
         string_agg('{{"index": ' || CAST(rank - 1 AS VARCHAR) || ', "relevance_score": ' || printf('%.6f', score) || '}}',
                    ', ' ORDER BY -round(score, 12), rank) AS items
  FROM rscored GROUP BY query_id),
bodies AS (
  SELECT query_id, CASE WHEN qa_id % 3 = 0 THEN '{{"results": []}}' WHEN qa_id % 3 = 1 THEN 'not json'
                        ELSE '{{"results": [' || items || ']}}' END AS body FROM items),
res AS (
  SELECT query_id, unnest(CAST(json_extract(body, '$.results[*].index') AS BIGINT[])) AS idx,
         generate_subscripts(CAST(json_extract(body, '$.results[*].index') AS BIGINT[]), 1) - 1 AS position
  FROM bodies WHERE json_valid(body)),
tscore AS (SELECT query_id, idx + 1 AS rank, -CAST(position AS DOUBLE) AS score FROM res),
used AS (SELECT DISTINCT query_id FROM tscore),
h2 AS (
  SELECT h.*, t.score AS tscore, u.query_id IS NOT NULL AS from_table
  FROM hits h LEFT JOIN tscore t ON t.query_id = h.query_id AND t.rank = h.rank
  LEFT JOIN used u ON u.query_id = h.query_id WHERE h.rerank),
r2 AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN from_table THEN tscore END DESC NULLS LAST, rank)
            AS rerank_rank FROM h2)
SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, CAST(rerank_rank AS BIGINT) AS rerank_rank, from_table
FROM r2 WHERE NOT from_table OR trim(question) = '' OR reranker_top_n IS NULL OR rerank_rank <= reranker_top_n"""


def flagship_sql() -> str:
    return f"""WITH RECURSIVE {retrieval_ctes()},
answers AS (SELECT *, coalesce(guard_answer, context[1]) AS final_answer FROM prompts),
apairs AS (SELECT query_id AS k, std_text AS a, final_answer AS b FROM answers),
{cosine_ctes('a', 'apairs')},
metrics AS (
  SELECT a.experiment_id, a.qa_id, c.cosine_similarity,
         CAST(CASE WHEN {recall_sql('a.std_text', 'a.final_answer')} >= 0.5 THEN 2
                   WHEN {recall_sql('a.std_text', 'a.final_answer')} >= 0.2 THEN 1 ELSE 0 END AS DOUBLE) AS llm_score,
         {recall_sql('a.std_text', "array_to_string(a.context, chr(10))")} >= 0.5 AS covered
  FROM answers a JOIN acos c ON c.k = a.query_id),
tpairs AS (SELECT h.query_id || '#' || CAST(h.rank AS VARCHAR) AS k, h.query_id, h.chunk_text AS a, d.text AS b
           FROM hits h JOIN documents d ON d.doc_id = h.doc_id),
{cosine_ctes('t', 'tpairs')},
topk AS (SELECT q.experiment_id, avg(c.cosine_similarity) AS topk_vs_original
         FROM tpairs p JOIN tcos c ON c.k = p.k JOIN questions q ON q.query_id = p.query_id GROUP BY q.experiment_id),
rolled AS (
  SELECT experiment_id, CAST(count(*) AS BIGINT) AS n_questions,
         string_agg(printf('%.6f', cosine_similarity), ',' ORDER BY qa_id) AS cosine_similaritys,
         string_agg(printf('%.6f', llm_score), ',' ORDER BY qa_id) AS llm_evaluation_scores,
         sum(llm_score) / (2 * count(llm_score)) AS llm_score_ratio,
         avg(CAST(covered AS DOUBLE)) AS qa_recall
  FROM metrics GROUP BY experiment_id),
nch AS (SELECT collection, CAST(count(*) AS BIGINT) AS n_chunks FROM ch2 GROUP BY collection),
sepstr AS (SELECT name, CASE WHEN method = 'recursive_character_text_splitter'
                              THEN ', ''separators'': [''\\n\\n'', ''\\n'', '' '', '''']' ELSE '' END AS s FROM strategies)
SELECT e.experiment_id, e.file_type AS file_type_name, e.chunking_strategy AS chunking_strategy_name,
       e.method AS chunking_method, CAST(e.chunk_size AS BIGINT) AS chunk_size,
       CAST(e.chunk_overlap AS BIGINT) AS chunk_overlap,
       CAST(e.retrieval_n_results AS BIGINT) AS chunk_retrieval_nums, e.reranker_method AS reranker_model,
       CAST(e.reranker_top_n AS BIGINT) AS reranker_nums,
       '{{''chunk_size'': ' || CAST(e.chunk_size AS VARCHAR) || ', ''chunk_overlap'': ' || CAST(e.chunk_overlap AS VARCHAR)
         || ss.s || '}}' AS chunking_params,
       n.n_chunks, r.n_questions, r.cosine_similaritys, r.llm_evaluation_scores,
       round(r.llm_score_ratio, 6) AS llm_score_ratio, round(r.qa_recall, 6) AS qa_recall,
       round(t.topk_vs_original, 6) AS topk_vs_original, 'hashed-tf-md5-64' AS embedder
FROM exps e LEFT JOIN rolled r ON r.experiment_id = e.experiment_id LEFT JOIN topk t ON t.experiment_id = e.experiment_id
LEFT JOIN nch n ON n.collection = e.collection LEFT JOIN sepstr ss ON ss.name = e.chunking_strategy
WHERE e.reason IS NULL AND e.method <> 'outside'"""


ORACLE_FLAGSHIP = {
    "retrieve_lexical_k8": retrieve_sql(),
    "rerank_lexical_top4": rerank_sql(),
    "rerank_fallback": rerank_fallback_sql(),
    "context_assembly": context_sql(),
    "prompt_render": prompt_sql(),
    "flagship_strategy_ranking": flagship_sql(),
}
