"""Chunking: one document row -> many chunk rows.

Plan shape: map-side only. A document never leaves its partition: one Arrow UDF
(`shared_tokens.walk_pieces`) cuts it into leaves, merges them by the greedy walk and
returns the text in pieces from one chunk's end to the next and the chunks as ranges of pieces; chunk texts
are joined from these (so the time is linear in the document) and stripped natively, and `posexplode` yields the rows. Registered splitters cut their leaves natively. No exchange is needed, so skew in file types
or strategies costs nothing here.

Semantics (both splitters keep the separator at the start of the following
piece, drop empty pieces, merge greedily up to `chunk_size`, carry whole
pieces worth at most `chunk_overlap`, strip merged chunks and drop empty ones):

* line-merge (`simple_split`): separator "\\n"; a piece longer than
  `chunk_size` still enters the merge and ends up alone.
* recursive (`recursive_character_text_splitter`): the first separator of the
  list found in the text (or "" = every character) cuts it; pieces shorter
  than `chunk_size` are merged run by run, longer ones are cut again with the
  remaining separators, or emitted whole and unstripped when none remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.functions.text import DEFAULT_SEPARATORS, java_literal, py_strip
from slicewise.operators.shared_tokens import walk_pieces

# The walk reads one bigint per leaf: length * LEAF_SHIFT + flags, flags = depth*4 + good*2 + first.
LEAF_SHIFT = 1 << 12
MAX_SEPARATORS = 20                       # levels of one expression that the analyzer resolves

LINE_MERGE = "simple_split"
RECURSIVE = "recursive_character_text_splitter"
OUTSIDE = "outside"


# --------------------------------------------------------------------------- leaves
# Leaves are array<struct<p string, f int>>: the pieces that tile the text, in order, and their flags.
def line_leaves(text: Column) -> Column:
    """Pieces of the line-merge splitter: one run, all good."""
    pieces = F.transform(F.split(text, "\n", -1), lambda p, j: F.when(j == 0, p).otherwise(F.concat(F.lit("\n"), p)))
    return F.transform(F.filter(pieces, lambda p: F.length(p) > 0), lambda p: F.struct(p.alias("p"), F.lit(2).alias("f")))


def _sql_literal(s: str) -> str:
    """Spark SQL string literal of any text, written as UTF-16 \\u escapes."""
    units = s.encode("utf-16-be")
    return "'" + "".join("\\u%02x%02x" % (units[i], units[i + 1]) for i in range(0, len(units), 2)) + "'"


def recursive_leaves_sql(text_col: str, size_col: str, separators: list[str] | None = None) -> Column:
    """Leaves of the recursive splitter, one level of the expression per separator.

    The state is an array of segments (p text, f flags, o open). A level cuts every
    open segment that holds its separator (the last level: every open segment); pieces
    shorter than chunk_size are closed as good leaves, longer ones stay open
    for the separators that remain. The expression grows linearly with the list.
    """
    seps = list(separators) if separators else list(DEFAULT_SEPARATORS)
    seps = seps[:seps.index("") + 1] if "" in seps else seps
    if len(seps) > MAX_SEPARATORS:
        raise ValueError(f"{len(seps)} separators; one expression holds at most {MAX_SEPARATORS} (split_text takes any number)")
    t, size = f"`{text_col}`", f"`{size_col}`"
    state = (f"CASE WHEN length({t}) > 0 THEN array(named_struct('p', {t}, 'f', 0, 'o', true)) "
             f"ELSE CAST(array() AS array<struct<p string, f int, o boolean>>) END")
    for c, sep in enumerate(seps):
        last = c == len(seps) - 1
        x, q = f"x{c}", f"q{c}"
        if sep == "":
            pieces = f"split({x}.p, '')"
        else:
            pieces = (f"filter(transform(split({x}.p, {_sql_literal(java_literal(sep))}, -1), "
                      f"({q}, i{c}) -> CASE WHEN i{c} = 0 THEN {q} ELSE concat({_sql_literal(sep)}, {q}) END), {q} -> length({q}) > 0)")
        flags = f"(shiftright({x}.f, 2) + 1) * 4 + CASE WHEN length({q}) < {size} THEN 2 ELSE 0 END + CASE WHEN k{c} = 0 THEN 1 ELSE 0 END"
        is_open = "false" if last else f"length({q}) >= {size}"
        cut = f"transform({pieces}, ({q}, k{c}) -> named_struct('p', {q}, 'f', {flags}, 'o', {is_open}))"
        cond = f"{x}.o" if last or sep == "" else f"{x}.o AND instr({x}.p, {_sql_literal(sep)}) > 0"
        state = f"flatten(transform({state}, {x} -> CASE WHEN {cond} THEN {cut} ELSE array({x}) END))"
    return F.expr(state)


# --------------------------------------------------------------------------- chunks
def _ranges_to_chunks(pieces: Column, ranges: Column, vectors: Column | None = None, dims: int = 0) -> Column:
    """Join every range of pieces; strip merged ones; drop empty ones. Linear in the text.

    With `vectors` (`dims` numbers per range) a chunk is a struct of its text and its vector.
    """
    n = (F.size(ranges) / 3).cast("int")

    def chunk(k: Column) -> Column:
        start = F.element_at(ranges, k * 3 + 1)
        joined = F.array_join(F.slice(pieces, start + 1, F.element_at(ranges, k * 3 + 2) - start), "")
        text = F.when(F.element_at(ranges, k * 3 + 3) == 1, py_strip(joined)).otherwise(joined)
        if vectors is None:
            return text
        return F.struct(text.alias("chunk_text"), F.slice(vectors, k * dims + 1, dims).alias("embedding"))

    cut = F.transform(F.sequence(F.lit(0), n - 1), chunk)
    if vectors is not None:                                  # the walk with vectors lists no empty chunk
        return F.when(n > 0, cut).otherwise(F.array().cast("array<struct<chunk_text: string, embedding: array<double>>>"))
    return F.when(n > 0, F.filter(cut, lambda x: F.length(x) > 0)).otherwise(F.array().cast("array<string>"))


# Extra splitters by method name. A splitter is a function
# (text_col, size_col, separators) -> Column of array<struct<p:string, f:int>>:
# the pieces that tile the text (f = depth*4 + good*2 + first)
# which the shared merge walk then merges into chunks.
CUSTOM_SPLITTERS: dict = {}


def register_splitter(method: str, leaves_builder) -> None:
    CUSTOM_SPLITTERS[method] = leaves_builder


def known_methods() -> list[str]:
    return [LINE_MERGE, RECURSIVE, OUTSIDE, *CUSTOM_SPLITTERS]


def leaves_for(method: str, separators: list[str] | None, text_col: str, size_col: str) -> Column:
    """Leaves of a document under one splitter shape."""
    if method in CUSTOM_SPLITTERS:
        custom = CUSTOM_SPLITTERS[method](text_col, size_col, separators)
        return F.transform(custom, lambda x: F.struct(x["p"].alias("p"), x["f"].cast("int").alias("f")))
    if method == LINE_MERGE:
        return line_leaves(F.col(text_col))
    if method == RECURSIVE:
        return F.transform(recursive_leaves_sql(text_col, size_col, separators),
                           lambda x: F.struct(x["p"].alias("p"), x["f"].alias("f")))
    raise ValueError(f"no splitter is registered for method {method!r}")


def walk_columns(rows: DataFrame, text_col: str, size_col: str, overlap_col: str) -> list[Column]:
    """What the walk reads of a row: its text and shape; the leaves of a registered splitter, joined and as codes; size and overlap."""
    if "_leaves" in rows.columns:
        pieces = F.array_join(F.col("_leaves.p"), "")
        codes = F.transform("_leaves", lambda x: F.length(x["p"]).cast("bigint") * LEAF_SHIFT + x["f"])
    else:
        pieces, codes = F.lit(None).cast("string"), F.lit(None).cast("array<bigint>")
    return [F.col(text_col), F.col("_shape"), pieces, codes, F.col(size_col), F.col(overlap_col)]


def _chunk_lists(rows: DataFrame, shapes: list, keep: list[str], text_col: str, size_col: str, overlap_col: str, dims: int | None = None) -> DataFrame:
    walk = walk_pieces(shapes, dims)(*walk_columns(rows, text_col, size_col, overlap_col))
    vectors = F.col("_walk.vectors") if dims else None
    chunks = _ranges_to_chunks(F.col("_walk.pieces"), F.col("_walk.ranges"), vectors, dims or 0)
    return rows.withColumn("_walk", walk).select(*keep, chunks.alias("chunks"))


def exploded(lists: DataFrame, keep: list[str]) -> DataFrame:
    """One row per chunk of the list column `chunks`."""
    # outer, for the plain form infers a filter on `chunks`; pushed below, it would cut and join every chunk once more
    rows = lists.select(*keep, F.posexplode_outer("chunks").alias("chunk_index", "chunk_text"))
    return rows.filter(F.col("chunk_index").isNotNull())


def split_text(df: DataFrame, method: str, separators: list[str] | None = None,
               text_col: str = "text", size_col: str = "chunk_size",
               overlap_col: str = "chunk_overlap") -> DataFrame:
    """Chunk every row of `df` with one splitter; parameters are per-row columns.

    Output: the input columns except the text, plus chunk_index (int) and
    chunk_text (string), one row per chunk. A null or empty text has no chunks.
    More separators than one expression holds take the splitter by fragments, which has no such limit.
    """
    if method == RECURSIVE and len(separators or ()) > MAX_SEPARATORS:
        from slicewise.operators.long_documents import split_long_text
        return split_long_text(df, method, separators, text_col, size_col, overlap_col)
    keep = [c for c in df.columns if c != text_col]
    if method in CUSTOM_SPLITTERS:
        staged = df.withColumn("_shape", F.lit(None).cast("int")).withColumn("_leaves", leaves_for(method, separators, text_col, size_col))
        return exploded(_chunk_lists(staged, [], keep, text_col, size_col, overlap_col), keep)
    staged, shapes = df.withColumn("_shape", F.lit(0)), [walk_separators(method, separators)]
    return exploded(_chunk_lists(staged, shapes, keep, text_col, size_col, overlap_col), keep)


def _shapes(strategies_rows: list) -> list[tuple[str, tuple | None]]:
    shapes = []
    for row in strategies_rows:
        method = row["method"]
        if method == OUTSIDE or method not in known_methods():     # resolve() rejects unknown ones
            continue
        seps = tuple(row["separators"]) if row["separators"] else None
        if method == LINE_MERGE:
            seps = None
        if (method, seps) not in shapes:
            shapes.append((method, seps))
    return shapes


def chunk_pairs(pairs: DataFrame, strategies_rows: list, text_col: str = "text",
                size_col: str = "chunk_size", overlap_col: str = "chunk_overlap", dims: int | None = None) -> DataFrame:
    """Chunk (document, strategy) rows in one pass over the corpus, one row per chunk.

    dims: also `embedding`, the chunk's lexical vector (X7) of that length, from one tokenisation per document.
    """
    keep = [c for c in pairs.columns if c != text_col]
    rows = exploded(pair_chunk_lists(pairs, strategies_rows, text_col, size_col, overlap_col, dims), keep)
    return rows.select(*keep, "chunk_index", "chunk_text.chunk_text", "chunk_text.embedding") if dims else rows


def walk_separators(method: str, separators: list[str] | None) -> list[str] | None:
    """How the walk cuts a built-in shape: None for lines, else the recursive splitter's separators."""
    if method == LINE_MERGE:
        return None
    if method != RECURSIVE:
        raise ValueError(f"no splitter is registered for method {method!r}")
    seps = list(separators) if separators else list(DEFAULT_SEPARATORS)
    seps = seps[:seps.index("") + 1] if "" in seps else seps
    if len(seps) > MAX_SEPARATORS:
        raise ValueError(f"{len(seps)} separators; a strategy of a batch holds at most {MAX_SEPARATORS} (split_text takes any number)")
    return seps


def pair_shapes(pairs: DataFrame, strategies_rows: list, text_col: str = "text", size_col: str = "chunk_size") -> tuple[DataFrame, list]:
    """The rows that are chunked here with the shape of their strategy (column _shape), and how each shape is cut.

    `pairs` carries the strategy columns (method, separators, chunk_size,
    chunk_overlap). `strategies_rows` are the configuration rows that may occur
    in `pairs`; each (method, separators) shape becomes one branch of a CASE,
    so the corpus is scanned once whatever the number of strategies. Rows of a registered
    splitter have no shape, but the leaves that it cuts (column _leaves).
    `outside` rows are skipped (see sources.prechunked), and an
    empty separator list means the default one, as null does.
    """
    shapes = _shapes(strategies_rows)
    shape, leaves, known, cut = F.lit(None).cast("int"), None, F.lit(False), []
    for method, seps in shapes:
        cond = F.col("method") == method
        if method != LINE_MERGE:
            cond = cond & ((F.coalesce(F.size("separators"), F.lit(0)) <= 0) if seps is None
                           else (F.col("separators") == F.array(*[F.lit(x) for x in seps])))
        if method in CUSTOM_SPLITTERS:
            expr = leaves_for(method, list(seps) if seps else None, text_col, size_col)
            leaves = F.when(cond, expr) if leaves is None else leaves.when(cond, expr)
        else:
            shape = F.when(cond, F.lit(len(cut))).otherwise(shape)
            cut.append(walk_separators(method, list(seps) if seps else None))
        known = known | F.coalesce(cond, F.lit(False))
    # a null text has no lines
    some = known & ((F.col("method") != LINE_MERGE) | F.col(text_col).isNotNull())
    rows = pairs.filter(F.col("method").isin([m for m, _ in shapes])).filter(some).withColumn("_shape", shape)
    if leaves is None:
        return rows, cut
    return rows.withColumn("_leaves", leaves).filter(F.col("_shape").isNotNull() | F.col("_leaves").isNotNull()), cut


def pair_chunk_lists(pairs: DataFrame, strategies_rows: list, text_col: str = "text", size_col: str = "chunk_size",
                     overlap_col: str = "chunk_overlap", dims: int | None = None) -> DataFrame:
    """The input columns (text included) and `chunks`, the list of a row's chunk texts (see `pair_shapes`).

    dims: structs of chunk_text and embedding instead (see `chunk_pairs`).
    """
    rows, shapes = pair_shapes(pairs, strategies_rows, text_col, size_col)
    return _chunk_lists(rows, shapes, pairs.columns, text_col, size_col, overlap_col, dims)
