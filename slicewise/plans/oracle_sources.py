"""DuckDB statements for the source and QA queries."""

from __future__ import annotations

from slicewise.plans.oracle import strip

PRECHUNKED_SQL = """
WITH v AS (SELECT 'conversations' AS collection, conv_id AS id, text AS pageContent, conv_id * 4294967296 + turn AS ord
           FROM conversations),
g AS (SELECT collection, id, arg_max(pageContent, ord) AS chunk_text, min(ord) AS first_ord FROM v GROUP BY collection, id)
SELECT collection, id AS chunk_id, CAST(row_number() OVER (PARTITION BY collection ORDER BY first_ord) - 1 AS BIGINT)
       AS chunk_index, chunk_text, 0.0::DOUBLE AS chunk_times_s
FROM g WHERE chunk_text IS NOT NULL AND chunk_text <> ''
"""

QUOTE = "''''"                      # SQL literal of one apostrophe
ITEM_RE = "'''([^'']*?)'''"          # SQL literal of the regex '([^']*?)'


def qa_files_sql() -> str:
    return f"""
conv AS (
  SELECT conv_id, turn,
         CASE role WHEN 'user' THEN 'Q: ' || text
                   WHEN 'assistant' THEN 'A: [' || array_to_string(list_transform(string_split(text, chr(10)),
                                                    lambda x: {QUOTE} || x || {QUOTE}), ', ') || ']'
                   ELSE 'S: ' || text END AS line
  FROM conversations),
files AS (SELECT 'qa/conv_' || CAST(conv_id AS VARCHAR) || '_qa_pairs.txt' AS path,
                 string_agg(line, chr(10) ORDER BY turn) AS value FROM conv GROUP BY conv_id)"""


def qa_parse_ctes(files: str = "files") -> str:
    """parsed(path, qa_index, question, answers) from whole-text files."""
    return f"""
ls AS (SELECT path, string_split(replace(replace(value, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS arr
       FROM {files}),
raw AS (SELECT path, unnest(arr) AS l0, generate_subscripts(arr, 1) AS j FROM ls),
qal AS (SELECT path, j, {strip('l0')} AS l FROM raw),
qa2 AS (SELECT path, j, l FROM qal WHERE starts_with(l, 'Q:') OR starts_with(l, 'A:')),
pr AS (SELECT path, j, l AS a, lag(l) OVER (PARTITION BY path ORDER BY j) AS q FROM qa2),
pairs AS (SELECT path, j, q, a, {strip('substring(a, 4)')} AS ans FROM pr
          WHERE starts_with(a, 'A:') AND starts_with(q, 'Q:')),
parsed AS (
  SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY j) - 1 AS BIGINT) AS qa_index,
         {strip('substring(q, 4)')} AS question,
         CASE WHEN starts_with(ans, '[') AND ends_with(ans, ']')
              THEN regexp_extract_all(substring(ans, 2, length(ans) - 2), {ITEM_RE}, 1)
              ELSE [ans] END AS answers
  FROM pairs)"""


def qa_parse_sql() -> str:
    return f"""
WITH {qa_files_sql()}, {qa_parse_ctes()}
SELECT path, qa_index, question, array_to_string(answers, chr(31)) AS answers_text,
       CAST(len(answers) AS BIGINT) AS n_answers
FROM parsed"""


QA_POOL_SQL = """
SELECT q.conv_id * 4294967296 + q.turn AS qa_id, 'src' || CAST(q.conv_id % 20 AS VARCHAR) AS file_type,
       q.text AS question, string_split(a.text, chr(10)) AS answers
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'"""


def qa_sample_ctes(n: int = 8, seed: str = "seed0") -> str:
    return f"""
qa AS ({QA_POOL_SQL}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY file_type ORDER BY md5('{seed}' || question), qa_id)
                          AS BIGINT) AS sample_rank FROM qa),
sampled AS (SELECT * FROM ranked WHERE sample_rank <= {n})"""


QA_SAMPLE_SQL = f"""
WITH {qa_sample_ctes()}
SELECT file_type, qa_id, question, sample_rank FROM sampled"""

ORACLE_SOURCES = {
    "prechunked_ingest": PRECHUNKED_SQL,
    "qa_file_parse": qa_parse_sql(),
    "qa_sample_8": QA_SAMPLE_SQL,
}
