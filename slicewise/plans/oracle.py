"""DuckDB SQL statements of the registered queries (the correctness oracle).

Each string runs on the driver tables registered as views. Integers are
BIGINT, doubles are rounded to 6 places, arrays are rendered as joined
strings, and every column carries the same name as on the Spark side.
"""

from __future__ import annotations

# Python str.strip() whitespace, as an RE2 class (same characters as functions.text.STRIP_CLASS).
STRIP_RE2 = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
TOKEN_RE2 = r"[\p{L}\p{N}_]{2,}"


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{STRIP_RE2}+', ''), '{STRIP_RE2}+$', '')"


def line_pieces_cte(docs_sql: str = "SELECT doc_id, text FROM documents") -> str:
    """pieces(doc_id, i, len, cs, ce, n, text): line pieces with the newline kept in front."""
    return f"""
src AS ({docs_sql}),
parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS p,
         generate_subscripts(string_split(text, chr(10)), 1) AS j
  FROM src),
pieces0 AS (
  SELECT doc_id, j, CAST(length(p) AS BIGINT) + CASE WHEN j = 1 THEN 0 ELSE 1 END AS len FROM parts),
pieces1 AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i, len
  FROM pieces0 WHERE len > 0),
pieces AS (
  SELECT doc_id, i, len,
         CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len AS BIGINT) AS cs,
         CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ce,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM pieces1)"""


def merge_chain_ctes(size: int, overlap: int, pieces: str = "pieces") -> str:
    """Greedy merge over `pieces` (doc_id, i, cs, ce, n) as a recursive walk of chunk starts."""
    return f"""
hit AS (
  SELECT a.doc_id, a.i AS s, a.n, b.i AS e_raw
  FROM {pieces} a ASOF LEFT JOIN {pieces} b ON a.doc_id = b.doc_id AND b.ce > a.cs + {size}),
emit AS (
  SELECT h.doc_id, h.s, h.n,
         CASE WHEN h.e_raw IS NULL OR greatest(h.e_raw, h.s + 1) >= h.n THEN NULL
              ELSE greatest(h.e_raw, h.s + 1) END AS e
  FROM hit h),
emitv AS (
  SELECT m.doc_id, m.s, m.e, greatest(p.cs - {overlap}, p.ce - {size}) AS v
  FROM emit m LEFT JOIN {pieces} p ON p.doc_id = m.doc_id AND p.i = m.e),
step AS (
  SELECT x.doc_id, x.s, x.e, CASE WHEN x.e IS NULL THEN NULL ELSE least(x.e, c.i) END AS nxt
  FROM emitv x ASOF LEFT JOIN {pieces} c ON x.doc_id = c.doc_id AND c.cs >= x.v),
chain(doc_id, s) AS (
  SELECT DISTINCT doc_id, 0 FROM {pieces}
  UNION ALL
  SELECT st.doc_id, st.nxt FROM chain ch JOIN step st ON st.doc_id = ch.doc_id AND st.s = ch.s
  WHERE st.nxt IS NOT NULL),
ranges AS (
  SELECT ch.doc_id, ch.s, coalesce(st.e, ps.n) AS e
  FROM chain ch JOIN step st ON st.doc_id = ch.doc_id AND st.s = ch.s
  JOIN (SELECT DISTINCT doc_id, n FROM {pieces}) ps ON ps.doc_id = ch.doc_id),
offsets AS (
  SELECT r.doc_id, r.s, ps.cs AS start_off,
         coalesce(pe.cs, (SELECT max(ce) FROM {pieces} z WHERE z.doc_id = r.doc_id)) AS end_off
  FROM ranges r JOIN {pieces} ps ON ps.doc_id = r.doc_id AND ps.i = r.s
  LEFT JOIN {pieces} pe ON pe.doc_id = r.doc_id AND pe.i = r.e)"""


def line_merge_sql(size: int, overlap: int) -> str:
    return f"""
WITH RECURSIVE {line_pieces_cte()},
{merge_chain_ctes(size, overlap)},
cut AS (
  SELECT o.doc_id, o.s, {strip('substring(d.text, o.start_off + 1, o.end_off - o.start_off)')} AS chunk_text
  FROM offsets o JOIN documents d ON d.doc_id = o.doc_id)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS BIGINT) AS chunk_index,
       CAST(length(chunk_text) AS BIGINT) AS chunk_chars, chunk_text
FROM cut WHERE length(chunk_text) > 0
"""


def _sql_lit(s: str) -> str:
    """A DuckDB string expression equal to s (control characters via chr)."""
    if s == "":
        return "''"
    return " || ".join(f"chr({ord(ch)})" if ord(ch) < 32 else "'" + ch.replace("'", "''") + "'" for ch in s)


def recursive_leaves_ctes(size: int, seps: list[str], docs_sql: str = "SELECT doc_id, text FROM documents") -> str:
    """items(doc_id, path, txt, kind): the split tree; kind is node / good / whole."""
    last = len(seps) - 1
    whens = []
    for c, sep in enumerate(seps):
        if sep == "" or c == last:
            break
        whens.append(f"WHEN m <= {c} AND contains(txt, {_sql_lit(sep)}) THEN {c}")
    default = next((c for c, sep in enumerate(seps) if sep == ""), last)
    choice = "CASE " + " ".join(whens) + f" ELSE {default} END" if whens else str(default)
    sep_of = "CASE c " + " ".join(f"WHEN {c} THEN {_sql_lit(sep)}" for c, sep in enumerate(seps)) + " END"
    rem_of = "CASE c " + " ".join(
        f"WHEN {c} THEN {'true' if (sep != '' and c < last) else 'false'}" for c, sep in enumerate(seps)) + " END"
    return f"""
items(doc_id, path, txt, m, kind) AS (
  SELECT doc_id, []::BIGINT[], text, 0, 'node' FROM ({docs_sql}) WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, list_append(path, k), piece, c + 1,
         CASE WHEN length(piece) < {size} THEN 'good' WHEN rem THEN 'node' ELSE 'whole' END
  FROM (
    SELECT doc_id, path, c, rem, unnest(pcs) AS piece, generate_subscripts(pcs, 1) AS k
    FROM (
      SELECT doc_id, path, c, rem,
             list_filter(CASE WHEN sep = '' THEN string_split(txt, '')
                              ELSE list_transform(string_split(txt, sep),
                                                  lambda p, ix: CASE WHEN ix = 1 THEN p ELSE sep || p END) END,
                         lambda x: length(x) > 0) AS pcs
      FROM (SELECT doc_id, path, txt, c, {sep_of} AS sep, {rem_of} AS rem
            FROM (SELECT *, {choice} AS c FROM items WHERE kind = 'node') z0) z1) z2) z3),
leaves AS (
  SELECT doc_id, path, kind, CAST(length(txt) AS BIGINT) AS len,
         path[1:len(path) - 1] AS parent,
         sum(CASE WHEN kind = 'good' THEN 0 ELSE 1 END) OVER (
             PARTITION BY doc_id, path[1:len(path) - 1] ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg
  FROM items WHERE length(path) > 0),
tiles AS (
  SELECT doc_id, path, kind, len, parent, seg,
         CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len
              AS BIGINT) AS off
  FROM leaves WHERE kind <> 'node'),
runs AS (
  SELECT doc_id AS real_doc, CAST(doc_id AS VARCHAR) || '/' || CAST(parent AS VARCHAR) || '/' || CAST(seg AS VARCHAR) AS run,
         path, len, off FROM tiles WHERE kind = 'good'),
pieces AS (
  SELECT run AS doc_id, real_doc,
         row_number() OVER (PARTITION BY run ORDER BY path) - 1 AS i, len,
         CAST(sum(len) OVER (PARTITION BY run ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len AS BIGINT) AS cs,
         CAST(sum(len) OVER (PARTITION BY run ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ce,
         count(*) OVER (PARTITION BY run) AS n,
         min(off) OVER (PARTITION BY run) AS base
  FROM runs)"""


def recursive_sql(size: int, overlap: int, seps: list[str] | None = None,
                  docs_sql: str = "SELECT doc_id, text FROM documents") -> str:
    seps = seps if seps is not None else ["\n\n", "\n", " ", ""]
    return f"""
WITH RECURSIVE {recursive_leaves_ctes(size, seps, docs_sql)},
{merge_chain_ctes(size, overlap)},
cut AS (
  SELECT p.real_doc AS doc_id, p.base + o.start_off AS start_off,
         {strip('substring(d.text, p.base + o.start_off + 1, o.end_off - o.start_off)')} AS chunk_text
  FROM offsets o JOIN (SELECT DISTINCT doc_id, real_doc, base FROM pieces) p ON p.doc_id = o.doc_id
  JOIN ({docs_sql}) d ON d.doc_id = p.real_doc
  UNION ALL
  SELECT t.doc_id, t.off, substring(d.text, t.off + 1, t.len)
  FROM tiles t JOIN ({docs_sql}) d ON d.doc_id = t.doc_id WHERE t.kind = 'whole')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_off) - 1 AS BIGINT) AS chunk_index,
       CAST(length(chunk_text) AS BIGINT) AS chunk_chars, chunk_text
FROM cut WHERE length(chunk_text) > 0
"""


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def collection_sql(ft: str, st: str, run_id: str = "run0") -> str:
    raw = (f"replace(lower(replace({ft}, ' ', '_')) || '_' || lower(replace({st}, ' ', '_')), '-', '_')"
           f" || '_' || {_q(run_id)}")
    clean = f"regexp_replace(substring({raw}, 1, 60), '[^\\p{{L}}\\p{{N}}_.]', '_', 'g')"
    return (f"(CASE WHEN regexp_matches({clean}, '^[\\p{{L}}\\p{{N}}]') AND regexp_matches({clean}, '[\\p{{L}}\\p{{N}}]$') "
            f"THEN {clean} ELSE 'c' || substring({clean}, 2, greatest(length({clean}) - 2, 0)) || 'c' END)")


def experiments_ctes() -> str:
    """exps(...) resolved with defaults, strategies and reject reasons."""
    from slicewise.sources.tables import SHIPPED_STRATEGIES
    from slicewise.sources.testdata import MISSING_FILE_TYPE, SETTINGS
    settings = ", ".join(f"({n}, {_q(st)}, {_q(r)}, {_q(m)}, {_q(t)}, {_q(k)})" for n, st, r, m, t, k in SETTINGS)
    strategies = ", ".join(f"({p}, {_q(nm)}, {_q(me)}, {_q(cs)}, {_q(co)})"
                           for p, nm, me, cs, co, *_ in SHIPPED_STRATEGIES)
    return f"""
ft AS (SELECT DISTINCT source AS file_type FROM documents UNION SELECT {_q(MISSING_FILE_TYPE)}),
settings(n, chunking_strategy, rerank, reranker_method, reranker_top_n, retrieval_n_results) AS (VALUES {settings}),
strategies(position, name, method, chunk_size, chunk_overlap) AS (VALUES {strategies}),
st AS (SELECT name, arg_min(method, position) AS method, arg_min(chunk_size, position) AS chunk_size,
              arg_min(chunk_overlap, position) AS chunk_overlap FROM strategies GROUP BY name),
exps0 AS (
  SELECT ft.file_type || '#' || CAST(s.n AS VARCHAR) AS experiment_id, ft.file_type, s.chunking_strategy,
         coalesce(s.rerank, false) AS rerank,
         CASE WHEN coalesce(s.rerank, false) THEN coalesce(s.reranker_method, '') ELSE 'Null' END AS reranker_method,
         CASE WHEN coalesce(s.rerank, false) THEN coalesce(s.reranker_top_n, 4) ELSE 0 END AS reranker_top_n,
         coalesce(s.retrieval_n_results, 8) AS retrieval_n_results
  FROM ft CROSS JOIN settings s),
exps AS (
  SELECT e.*, st.method, st.chunk_size, st.chunk_overlap,
         CASE WHEN e.file_type NOT IN (SELECT DISTINCT source FROM documents) THEN
                   CASE WHEN e.file_type IN (SELECT file_type FROM ft) THEN 'no text for file type' ELSE 'unknown file type' END
              WHEN st.name IS NULL THEN 'unknown strategy' END AS reason,
         {collection_sql('e.file_type', 'e.chunking_strategy')} AS collection,
         sha256(concat_ws(chr(1), e.file_type, e.chunking_strategy, 'run0')) AS collection_id
  FROM exps0 e LEFT JOIN st ON st.name = e.chunking_strategy)"""


def resolve_sql() -> str:
    return f"""WITH {experiments_ctes()}
SELECT experiment_id, file_type, chunking_strategy, method, CAST(chunk_size AS BIGINT) AS chunk_size,
       CAST(chunk_overlap AS BIGINT) AS chunk_overlap, rerank, reranker_method,
       CAST(reranker_top_n AS BIGINT) AS reranker_top_n, CAST(retrieval_n_results AS BIGINT) AS retrieval_n_results,
       collection
FROM exps WHERE reason IS NULL"""


def rejects_sql() -> str:
    return f"""WITH {experiments_ctes()}
SELECT experiment_id, file_type, chunking_strategy, reason FROM exps WHERE reason IS NOT NULL"""


def all_chunks_sql() -> str:
    """Chunks of every resolved (file type, strategy) pair: one SELECT per shipped split strategy."""
    from slicewise.sources.tables import SHIPPED_STRATEGIES
    parts = []
    for _, name, method, size, overlap, seps, *_ in SHIPPED_STRATEGIES:
        if method == "simple_split":
            body = line_merge_sql(size, overlap)
        elif method == "recursive_character_text_splitter":
            body = recursive_sql(size, overlap, seps)
        else:
            continue
        parts.append(f"SELECT {_q(name)} AS chunking_strategy, c.* FROM ({body}) c")
    union = "\nUNION ALL\n".join(parts)
    return f"""(
WITH {experiments_ctes()},
pairs AS (SELECT DISTINCT file_type, chunking_strategy, collection, collection_id FROM exps
          WHERE reason IS NULL AND method <> 'outside'),
chunks AS ({union})
SELECT p.collection, p.collection_id, p.file_type, p.chunking_strategy, d.doc_id, d.n_chars AS original_text_length,
       c.chunk_index, c.chunk_text
FROM chunks c JOIN documents d ON d.doc_id = c.doc_id
JOIN pairs p ON p.file_type = d.source AND p.chunking_strategy = c.chunking_strategy)"""


def chunk_matrix_sql() -> str:
    return f"""
SELECT file_type, chunking_strategy, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs,
       CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(length(chunk_text)) AS BIGINT) AS total_chars,
       CAST(max(length(chunk_text)) AS BIGINT) AS max_chars,
       round(sum(length(chunk_text)) / count(*), 6) AS avg_chars
FROM {all_chunks_sql()} a GROUP BY file_type, chunking_strategy"""


def chunk_ids_sql() -> str:
    return f"""
SELECT collection, sha256(concat_ws(chr(1), collection_id, CAST(doc_id AS VARCHAR), CAST(chunk_index AS VARCHAR))) AS chunk_id,
       file_type AS source_file_type, chunking_strategy, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index,
       CAST(original_text_length AS BIGINT) AS original_text_length
FROM {all_chunks_sql()} a"""


ORACLE: dict[str, str] = {
    "chunk_lines_1000_200": line_merge_sql(1000, 200),
    "chunk_lines_100_10": line_merge_sql(100, 10),
    "chunk_recursive_150_15": recursive_sql(150, 15),
    "chunk_lines_by_fragments": line_merge_sql(100, 10),
    "chunk_recursive_by_fragments": recursive_sql(150, 15),
    "resolve_experiments": resolve_sql(),
    "experiment_rejects": rejects_sql(),
    "chunk_matrix": chunk_matrix_sql(),
    "chunk_ids": chunk_ids_sql(),
}


def _extend() -> None:
    from slicewise.plans.oracle_metrics import ORACLE_METRICS
    from slicewise.plans.oracle_sources import ORACLE_SOURCES
    ORACLE.update(ORACLE_SOURCES)
    ORACLE.update(ORACLE_METRICS)
    from slicewise.plans.oracle_retrieval import ORACLE_RETRIEVAL
    ORACLE.update(ORACLE_RETRIEVAL)
    from slicewise.plans.oracle_replies import ORACLE_REPLIES
    ORACLE.update(ORACLE_REPLIES)
    from slicewise.plans.oracle_flagship import ORACLE_FLAGSHIP
    from slicewise.plans.oracle_more import ORACLE_MORE
    ORACLE.update(ORACLE_FLAGSHIP)
    ORACLE.update(ORACLE_MORE)


_extend()
