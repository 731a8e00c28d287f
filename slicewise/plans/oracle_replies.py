r"""DuckDB statements for the model-reply queries.

Inputs are rebuilt with the same string expressions as `sources.model_replies`;
parsing restates the rules with DuckDB's JSON functions. In SQL literals here
'\n' and '\"' are two characters (backslash + letter), as in the Spark code.
"""

from __future__ import annotations

from slicewise.functions.replies import JUSTIFICATION_PATTERN, QA_OBJECT_PATTERN, SCORE_PATTERN
from slicewise.plans.oracle_sources import QA_POOL_SQL


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def one_json(x: str) -> str:
    w = f"('[' || ({x}) || ']')"
    return f"(CASE WHEN json_valid({w}) AND json_array_length({w}) = 1 THEN json_extract({w}, '$[0]') END)"


def is_qa(x: str) -> str:
    return (f"(({x}) IS NOT NULL AND json_type({x}) = 'OBJECT' AND json_exists({x}, '$.question') "
            f"AND coalesce(json_type({x}, '$.answers') = 'ARRAY', false))")


CHAT_SQL = r"""
WITH src AS (
  SELECT conv_id * 4294967296 + turn AS request_id,
         CASE WHEN role = 'system' THEN text
              WHEN role = 'user' THEN '{"model": "chat-m", "usage": {"total_tokens": ' || CAST(length(text) AS VARCHAR) || '}, "choices": []}'
              WHEN turn % 4 = 1 THEN '{"model": "chat-m", "usage": {"total_tokens": ' || CAST(length(text) AS VARCHAR) || '}, '
                   || '"choices": [{"message": {"content": "' || replace(text, chr(10), '\n') || '"}}]}'
              ELSE '{"model": "chat-m", "usage": {"total_tokens": ' || CAST(length(text) AS VARCHAR) || '}, '
                   || '"choices": [{"message": {"content": "' || replace(text, chr(10), '\n') || '"'
                   || ', "reasoning_content": "' || replace(text, chr(10), '\n') || '"}}]}'
         END AS body
  FROM conversations),
v AS (SELECT request_id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body END AS j FROM src)
SELECT request_id, ok AS valid, CAST(json_extract(j, '$.usage.total_tokens') AS BIGINT) AS tokens_used,
       json_extract_string(j, '$.model') AS gen_model,
       json_extract_string(j, '$.choices[0].message.content') AS ans_content,
       json_extract_string(j, '$.choices[0].message.reasoning_content') AS thinking_content
FROM v"""

EMBEDDING_SQL = r"""
WITH src AS (
  SELECT vec_id AS chunk_id,
         CASE WHEN label = 3 THEN 'not json'
              WHEN label = 7 THEN '{"model": "emb-m", "usage": {"total_tokens": 8}, "data": []}'
              ELSE '{"model": "emb-m", "usage": {"total_tokens": 8}, "data": [{"embedding": ['
                   || array_to_string(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ', ')
                   || ']}]}' END AS body
  FROM embeddings),
v AS (SELECT chunk_id, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body END AS j FROM src),
e AS (SELECT chunk_id, ok, j, CAST(json_extract(j, '$.data[0].embedding') AS DOUBLE[]) AS emb FROM v)
SELECT chunk_id, ok AS valid, CAST(json_extract(j, '$.usage.total_tokens') AS BIGINT) AS tokens_used,
       json_extract_string(j, '$.model') AS model, CAST(len(emb) AS BIGINT) AS n_dims,
       CASE WHEN emb IS NOT NULL THEN round(list_reduce(list_prepend(0.0::DOUBLE, emb), lambda a, x: a + x), 6) END AS sum_embedding,
       round(emb[1], 6) AS first_value
FROM e"""


def qa_replies_ctes() -> str:
    return f"""
qa AS ({QA_POOL_SQL}),
objs AS (SELECT qa_id // 4294967296 AS conv_id, qa_id,
                '{{"question": "' || question || '", "answers": [' || '"' || array_to_string(answers, '", "') || '"' || ']}}' AS o, question
         FROM qa),
per AS (SELECT conv_id, list(o ORDER BY qa_id) AS os, list(question ORDER BY qa_id) AS qs FROM objs GROUP BY conv_id),
replies AS (
  SELECT conv_id,
         CASE conv_id % 5
           WHEN 0 THEN '```json' || chr(10) || '[' || array_to_string(os, ',' || chr(10)) || ', {{"question": "incomplete"}}]' || chr(10) || '```'
           WHEN 1 THEN 'Here you go: ' || array_to_string(os, ' and ')
           WHEN 2 THEN '[' || array_to_string(list_transform(os, lambda o: replace(o, '"', '\\"')), ', ') || ']'
           WHEN 3 THEN array_to_string(os, ' ')
           ELSE 'No pairs here: ' || array_to_string(qs, ', ') END AS reply
  FROM per),
spans AS (
  SELECT conv_id, reply,
         replace(replace(replace(coalesce(nullif(regexp_extract(reply, '(?s)[\\[{{].*[\\]}}]', 0), ''), reply),
                                 '\\"', '"'), '\\n', ''), chr(10), '') AS clean
  FROM replies),
parsed AS (SELECT conv_id, reply, {one_json('clean')} AS inner_json FROM spans),
items AS (
  SELECT conv_id,
         CASE WHEN inner_json IS NULL THEN 'fallback' ELSE 'json' END AS branch,
         CASE WHEN inner_json IS NULL THEN
                list_filter(list_transform(regexp_extract_all(reply, {_lit(QA_OBJECT_PATTERN)}, 0),
                                           lambda m: {one_json('m')}), lambda x: {is_qa('x')})
              WHEN json_type(inner_json) = 'ARRAY' THEN
                list_filter(json_extract(inner_json, '$[*]'), lambda x: {is_qa('x')})
              WHEN {is_qa('inner_json')} THEN [inner_json]
              ELSE []::JSON[] END AS xs
  FROM parsed)"""


def qa_extract_sql() -> str:
    return f"""
WITH {qa_replies_ctes()},
ex AS (SELECT conv_id, unnest(xs) AS item, generate_subscripts(xs, 1) - 1 AS qa_index FROM items)
SELECT conv_id, CAST(qa_index AS BIGINT) AS qa_index, json_extract_string(item, '$.question') AS question,
       array_to_string(json_extract_string(item, '$.answers[*]'), chr(31)) AS answers_text,
       CAST(len(json_extract_string(item, '$.answers[*]')) AS BIGINT) AS n_answers
FROM ex"""


def qa_fallback_sql() -> str:
    return f"""
WITH {qa_replies_ctes()}
SELECT conv_id, branch, CAST(len(xs) AS BIGINT) AS n_pairs FROM items"""


def judge_ctes() -> str:
    return f"""
qa AS ({QA_POOL_SQL}),
tries AS (SELECT qa_id, question, unnest(range(0, 3)) AS attempt FROM qa),
src AS (
  SELECT qa_id, CAST(attempt AS BIGINT) AS attempt,
         CASE (qa_id + attempt) % 6
           WHEN 0 THEN '{{"score": ' || CAST(length(question) % 3 AS VARCHAR) || ', "justification": "' || question || ' it\\''s fine"}}'
           WHEN 1 THEN '{{"score": ' || CAST(length(question) % 3 AS VARCHAR) || '.0, "justification": "' || question || '"}}'
           WHEN 2 THEN 'Verdict: {{"score": ' || CAST(length(question) % 3 AS VARCHAR) || '.0, "justification": "' || question || '" and more'
           WHEN 3 THEN '{{"score": "' || CAST(length(question) % 3 AS VARCHAR) || '", "justification": "' || question || '"}}'
           WHEN 4 THEN '{{"score": true, "justification": "' || question || '"}}'
           ELSE '{{"score": ' || CAST(length(question) % 3 + 3 AS VARCHAR) || ', "justification": "' || question || '"}}'
         END AS reply
  FROM tries),
sp AS (
  SELECT qa_id, attempt, reply,
         replace(replace(replace(coalesce(nullif(regexp_extract(reply, '(?s)\\{{.*\\}}', 0), ''), reply),
                                 '\\''', ''''), '\\n', ''), chr(10), '') AS clean
  FROM src),
pj AS (SELECT qa_id, attempt, reply, {one_json('clean')} AS obj FROM sp),
fields AS (
  SELECT qa_id, attempt, reply, obj IS NOT NULL AS is_json,
         coalesce(obj IS NOT NULL AND json_type(obj) = 'OBJECT' AND json_exists(obj, '$.score')
                  AND json_exists(obj, '$.justification'), false) AS json_ok,
         json_type(obj, '$.score') AS st,
         regexp_extract(reply, {_lit(SCORE_PATTERN)}, 1) AS score_txt,
         regexp_matches(reply, {_lit(JUSTIFICATION_PATTERN)}) AS just_found,
         regexp_extract(reply, {_lit(JUSTIFICATION_PATTERN)}, 1) AS rx_just,
         json_extract_string(obj, '$.justification') AS json_just,
         obj
  FROM pj),
scored AS (
  SELECT *,
         CASE WHEN is_json AND json_ok THEN
                CASE WHEN st IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(obj, '$.score') AS BIGINT)
                     WHEN st = 'BOOLEAN' THEN CASE WHEN json_extract_string(obj, '$.score') = 'true' THEN 1 ELSE 0 END END
              WHEN NOT is_json AND score_txt <> '' AND just_found THEN
                CASE WHEN TRY_CAST(score_txt AS DOUBLE) = floor(TRY_CAST(score_txt AS DOUBLE))
                     THEN CAST(floor(TRY_CAST(score_txt AS DOUBLE)) AS BIGINT) END
         END AS score0,
         CASE WHEN is_json THEN json_ok ELSE score_txt <> '' AND just_found END AS present
  FROM fields),
judged AS (
  SELECT qa_id, attempt, coalesce(present AND score0 IN (0, 1, 2), false) AS valid,
         CASE WHEN present AND score0 IN (0, 1, 2) THEN CAST(score0 AS BIGINT) END AS score,
         CASE WHEN present AND score0 IN (0, 1, 2) THEN CASE WHEN is_json THEN json_just ELSE rx_just END END AS justification,
         CASE WHEN is_json THEN 'json' ELSE 'fallback' END AS branch
  FROM scored)"""


def score_extract_sql() -> str:
    return f"""WITH {judge_ctes()}
SELECT qa_id, attempt, valid, score, justification, branch FROM judged"""


def score_retry_sql() -> str:
    return f"""WITH {judge_ctes()}
SELECT qa_id, CAST(count(*) AS BIGINT) AS attempts_seen,
       CAST(min(attempt) FILTER (WHERE valid) AS BIGINT) AS accepted_attempt,
       CAST(arg_min(score, attempt) FILTER (WHERE valid) AS BIGINT) AS score,
       min(attempt) FILTER (WHERE valid) IS NOT NULL AS resolved
FROM judged WHERE attempt < 3 GROUP BY qa_id"""


def judge_rounds_sql() -> str:
    """As score_retry_sql, but a request is asked no more once a reply was valid."""
    return f"""WITH {judge_ctes()},
first AS (SELECT qa_id, min(attempt) FILTER (WHERE valid) AS a FROM judged WHERE attempt < 3 GROUP BY qa_id)
SELECT f.qa_id, CAST(coalesce(f.a + 1, 3) AS BIGINT) AS attempts_seen, CAST(f.a AS BIGINT) AS accepted_attempt,
       j.score, f.a IS NOT NULL AS resolved
FROM first f LEFT JOIN judged j ON j.qa_id = f.qa_id AND j.attempt = f.a"""


ORACLE_REPLIES = {
    "judge_rounds": judge_rounds_sql(),
    "chat_envelope": CHAT_SQL,
    "embedding_envelope": EMBEDDING_SQL,
    "qa_extract": qa_extract_sql(),
    "qa_extract_fallback": qa_fallback_sql(),
    "score_extract": score_extract_sql(),
    "score_pending_retry": score_retry_sql(),
}
