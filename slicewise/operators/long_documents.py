"""C1 and C2 for documents of any length: one document over many tasks.

`chunking.split_text` cuts a document within its row. Here a document becomes fragments that are spread over
the cluster, and the chunks are the same. The start of a chunk depends on all chunks before it, but only through one
number, the place where it starts; so a fragment is a function from the place where the walk enters it to the place
where it leaves it, and functions compose:

1. cut: the row's task finds fragments of about `fragment_chars` characters, each a row of whole sibling pieces
   (pieces as long as a fragment are cut by the separators that remain, as the splitter itself would); a separate
   task per fragment then finds its leaves (places and flags, no text);
2. look-ahead: a walk near a fragment's end looks at most `chunk_size` characters and two leaves beyond it; these
   heads of the following fragments are handed to every fragment;
3. maps: every fragment computes, for each place where a walk can enter (a leaf within `chunk_size` characters of
   its start, or its first leaf), where it leaves; by pointer doubling, in parallel;
4. composition: per document the maps are applied in order, which gives every fragment its true entry;
5. chunks: every fragment walks from its entry and writes the chunks that start in it; a chunk that crosses a
   border takes the rest from the head's text. Positions among the document's chunks come from sums of counts.

Steps 2 and 4 see a document's heads and maps in one group. A value holds at most 2 GiB, a fragment at least
MIN_FRAGMENTS_PER_HEAD chunk sizes, so such a group is at most that fraction of one value. Leaves and chunks never meet in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slicewise.functions.text import DEFAULT_SEPARATORS
from slicewise.operators import chunking
from slicewise.session import cut_lineage

FRAGMENT_CHARS = 1 << 20
MIN_FRAGMENTS_PER_HEAD = 16           # a fragment is at least so many chunk sizes long
CHARS_PER_YIELD = 4 << 20             # text handed to Arrow at a time

# flags of a leaf, and of a leaf in the look-ahead
GOOD, FIRST, DEPTH = 1, 2, 4
NEW_RUN = 2


# --------------------------------------------------------------------------- pieces and leaves of a text
def _pieces(text: str, lo: int, hi: int, sep: str) -> Iterator[tuple[int, int]]:
    """Ranges of the pieces of text[lo:hi]; a separator starts the piece that follows it."""
    if sep == "":
        yield from ((i, i + 1) for i in range(lo, hi))
        return
    start, at = lo, text.find(sep, lo, hi)
    while at >= 0:
        if at > start:
            yield start, at
        start, at = at, text.find(sep, at + len(sep), hi)
    if start < hi:
        yield start, hi


def _separator(text: str, lo: int, hi: int, seps: list[str], level: int) -> int:
    """The first separator from `level` on that occurs; the last one when none does."""
    for c in range(level, len(seps)):
        if seps[c] == "" or text.find(seps[c], lo, hi) >= 0:
            return c
    return len(seps) - 1


def fragments(text: str, seps: list[str], limit: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(start, end, separator, depth, begins its parent): rows of whole sibling pieces that tile the text."""
    def cut(lo: int, hi: int, level: int, depth: int):
        c = _separator(text, lo, hi, seps, level)
        if seps[c] == "":
            for a in range(lo, hi, limit):
                yield a, min(a + limit, hi), c, depth, a == lo
            return
        begin = lo
        for a, b in _pieces(text, lo, hi, seps[c]):
            if c + 1 < len(seps) and b - a >= limit:
                if begin < a:
                    yield begin, a, c, depth, begin == lo
                yield from cut(a, b, c + 1, depth + 1)
                begin = b
            elif begin < a and b - begin > limit:
                yield begin, a, c, depth, begin == lo
                begin = a
        if begin < hi:
            yield begin, hi, c, depth, begin == lo

    if text:
        yield from cut(0, len(text), 0, 0)


def leaves(text: str, seps: list[str], c: int, depth: int, first: bool, size: int, all_good: bool) -> tuple[list[int], list[int]]:
    """Starts and flags of the leaves of a fragment."""
    starts: list[int] = []
    flags: list[int] = []

    def cut(lo: int, hi: int, c: int, depth: int, first: bool) -> None:
        mark = FIRST if first else 0
        for a, b in _pieces(text, lo, hi, seps[c]):
            if all_good or b - a < size:
                starts.append(a)
                flags.append(depth * DEPTH + mark + GOOD)
            elif c + 1 < len(seps):
                cut(a, b, _separator(text, a, b, seps, c + 1), depth + 1, True)
            else:
                starts.append(a)
                flags.append(depth * DEPTH + mark)
            mark = 0

    cut(0, len(text), c, depth, first)
    return starts, flags


def _new_runs(flags: np.ndarray, before: int) -> np.ndarray:
    """1 where a leaf cannot join the leaf before it (`before`: the flags of the leaf before the first, or -1)."""
    prev = np.concatenate(([before], flags[:-1]))
    joins = (prev >= 0) & ((flags & GOOD) > 0) & ((prev & GOOD) > 0) & ((flags & FIRST) == 0) & (flags // DEPTH == prev // DEPTH)
    return (~joins).astype(np.int64)


# --------------------------------------------------------------------------- the walk
def steps(pos: np.ndarray, good: np.ndarray, new: np.ndarray, n: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk that starts at leaf j < n: the leaf where it ends and the leaf where the next one starts.

    pos, good, new describe the fragment's n leaves and the look-ahead.
    """
    total = len(pos)
    run_end = np.where(new > 0, np.arange(total), total)
    run_end = np.append(np.minimum.accumulate(run_end[::-1])[::-1], total)[1:n + 1]
    j = np.arange(n)
    end = np.maximum(np.searchsorted(pos, pos[:n] + size, side="right") - 1, j + 1)
    whole = end >= run_end                            # the rest of the run fits
    i = np.minimum(end, total - 1)
    after = pos[np.minimum(i + 1, total - 1)]
    carry = np.searchsorted(pos, np.maximum(pos[i] - overlap, after - size), side="left")
    nxt = np.where(whole, run_end, np.minimum(end, carry))
    end = np.where(whole, run_end, end)
    alone = good[:n] == 0                             # an oversize leaf is a chunk by itself
    return np.where(alone, j + 1, end), np.where(alone, j + 1, nxt)


def leaving(nxt: np.ndarray, n: int) -> np.ndarray:
    """The first leaf at or beyond n that the walk from every leaf reaches, by pointer doubling."""
    jump = nxt.copy()
    while len(jump) and (jump < n).any():
        inside = jump < n
        jump[inside] = jump[jump[inside]]
    return jump


def _joined(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Leaves of a fragment and its look-ahead: places, good, new run; the number of its own leaves."""
    own = np.asarray(row.flags, dtype=np.int64)
    n = len(own)
    new = _new_runs(own, int(row.before))
    tail = np.asarray(row.tail_flags, dtype=np.int64)
    pos = np.concatenate([np.asarray(row.pos, dtype=np.int64), np.asarray(row.tail_pos, dtype=np.int64)])
    return pos, np.concatenate([own & GOOD, tail & GOOD]), np.concatenate([new, (tail & NEW_RUN) // NEW_RUN]), n


# --------------------------------------------------------------------------- Spark
def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    # objects: an inferred string type may come as several Arrow chunks, which the result's struct does not take
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


def _frames(rows: Iterator[tuple[int, tuple]], schema: str) -> Iterator[pd.DataFrame]:
    """Frames of many rows (size, row): one per row would cost far more than the row's work."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 64
        if size >= CHARS_PER_YIELD:
            yield _frame(held, schema)
            held, size = [], 0
    if held:
        yield _frame(held, schema)


def _documents(batches) -> Iterator[list]:
    """The rows of one document after the other; batches come sorted by document and fragment."""
    held: list = []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if held and held[-1][0] != r[0]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _cut(seps: list[str], fragment_chars: int, text_col: str, size_col: str, overlap_col: str):
    def found(batches):
        for batch in batches:
            for row, text, size, overlap in zip(batch["_row"], batch[text_col], batch[size_col], batch[overlap_col]):
                if not text:
                    continue
                limit = max(fragment_chars, MIN_FRAGMENTS_PER_HEAD * int(size))
                for k, (a, b, c, depth, first) in enumerate(fragments(text, seps, limit)):
                    yield b - a, (row, k, a, b, len(text), int(size), int(overlap), c, depth, first, text[a:b])
    return lambda batches: _frames(found(batches), CUT_SCHEMA)


CUT_SCHEMA = "_row long, _frag int, a long, b long, n long, size int, overlap int, sep int, depth int, first boolean, text string"
LEAF_SCHEMA = "_row long, _frag int, a long, b long, n long, size int, overlap int, text string, pos array<long>, flags array<int>, head int"
TAIL_SCHEMA = "_row long, _frag int, before int, tail_pos array<long>, tail_flags array<int>, tail_text string"
ENTRY_SCHEMA = "_row long, _frag int, entry long"
CHUNK_SCHEMA = "_row long, _frag int, _k int, chunk_text string"
MAP_SCHEMA = "_row long, _frag int, a long, b long, entries array<long>, exits array<long>"


def _find_leaves(seps: list[str], all_good: bool):
    def found(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                starts, flags = leaves(r.text, seps, r.sep, r.depth, r.first, r.size, all_good)
                pos = np.asarray(starts, dtype=np.int64) + r.a
                # what the fragment before may look at: leaves within chunk_size, and two more
                head = min(len(pos), int(np.searchsorted(pos, r.a + r.size, side="right")) + 2)
                yield r.b - r.a + 16 * len(pos), (r[0], r[1], r.a, r.b, r.n, r.size, r.overlap, r.text, pos, flags, head)
    return lambda batches: _frames(found(batches), LEAF_SCHEMA)


def look_ahead(rows: list) -> list[tuple]:
    """What follows each fragment of one document (rows: _frag, a, b, n, size, head_pos, head_flags, last_flag, whole, head_text)."""
    out = []
    # behind the document: its end, which starts a new run
    pos, code, text = np.array([rows[-1].n]), np.array([NEW_RUN]), ""
    for k in range(len(rows) - 1, -1, -1):
        r = rows[k]
        before = rows[k - 1].last_flag if k else -1
        keep = int(np.searchsorted(pos, r.b + r.size, side="right")) + 2
        out.append((r[0], r[1], before, pos[:keep], code[:keep], text[:r.size]))
        own = np.asarray(r.head_flags, dtype=np.int64)
        own_code = (own & GOOD) + NEW_RUN * _new_runs(own, before)
        own_pos = np.asarray(r.head_pos, dtype=np.int64)
        if r.whole:
            pos, code = np.concatenate([own_pos, pos[:keep]]), np.concatenate([own_code, code[:keep]])
        else:
            pos, code = own_pos, own_code
        # a head's text is chunk_size characters or the whole fragment
        text = (r.head_text + text)[:r.size]
    return out


def _tails(batches):
    return _frames(((len(t[5]) + 16 * len(t[3]), t) for rows in _documents(batches) for t in look_ahead(rows)), TAIL_SCHEMA)


def _map_rows(batches):
    for batch in batches:
        for r in batch.itertuples(index=False):
            pos, good, new, n = _joined(r)
            _, nxt = steps(pos, good, new, n, r.size, r.overlap)
            places = min(n, max(1, int(np.searchsorted(pos[:n], r.a + r.size, side="right"))))
            yield 16 * places, (r[0], r[1], r.a, r.b, pos[:places], pos[leaving(nxt, n)[:places]])


def _maps(batches):
    return _frames(_map_rows(batches), MAP_SCHEMA)


def compose(maps: list) -> Iterator[tuple]:
    """The place where the walk enters each fragment of one document that it enters."""
    at = 0
    for r in maps:
        if at < r.b:
            yield r[0], r[1], at
            at = int(r.exits[int(np.searchsorted(r.entries, at))])


def _entries(batches):
    return _frames(((0, e) for maps in _documents(batches) for e in compose(maps)), ENTRY_SCHEMA)


def _chunk_rows(batches):
    for batch in batches:
        for r in batch.itertuples(index=False):
            pos, good, new, n = _joined(r)
            end, nxt = steps(pos, good, new, n, r.size, r.overlap)
            j, found = int(np.searchsorted(pos[:n], r.entry)), []
            while j < n:
                lo, hi = int(pos[j]), int(pos[end[j]])
                piece = r.text[lo - r.a:hi - r.a]
                if hi > r.b:
                    piece += r.tail_text[:hi - r.b]
                piece = piece.strip() if good[j] else piece
                if piece:
                    found.append(piece)
                j = int(nxt[j])
            yield from ((len(piece), (r[0], r[1], k, piece)) for k, piece in enumerate(found))


def _chunks(batches):
    return _frames(_chunk_rows(batches), CHUNK_SCHEMA)


def split_long_text(df: DataFrame, method: str, separators: list[str] | None = None, text_col: str = "text",
                    size_col: str = "chunk_size", overlap_col: str = "chunk_overlap", fragment_chars: int = FRAGMENT_CHARS) -> DataFrame:
    """`chunking.split_text`, with every document spread over tasks by fragments.

    Output: the input columns except the text, plus chunk_index (int) and chunk_text, one row per chunk. A null or
    empty text has no chunks; rows may repeat, each is chunked by itself. The line and the recursive splitter only:
    a registered splitter gives no separators to cut fragments by.
    """
    if method not in (chunking.LINE_MERGE, chunking.RECURSIVE):
        raise ValueError(f"method {method!r} has no fragments")
    seps = ["\n"] if method == chunking.LINE_MERGE else list(separators or DEFAULT_SEPARATORS)
    seps = seps[:seps.index("") + 1] if "" in seps else seps
    keep = [c for c in df.columns if c != text_col]
    # the input is written once: row numbers must not change when a task is repeated
    base = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_keep"), F.col(text_col).alias("_text"),
                                 F.col(size_col).cast("int").alias("_size"), F.col(overlap_col).cast("int").alias("_overlap")))
    texts = base.select("_row", "_text", "_size", "_overlap").filter((F.length("_text") > 0) & F.col("_size").isNotNull() & F.col("_overlap").isNotNull())
    cut = texts.mapInPandas(_cut(seps, fragment_chars, "_text", "_size", "_overlap"), CUT_SCHEMA)
    frags = cut_lineage(cut.repartition("_row", "_frag").mapInPandas(_find_leaves(seps, method == chunking.LINE_MERGE), LEAF_SCHEMA))
    heads = frags.select("_row", "_frag", "a", "b", "n", "size", F.slice("pos", F.lit(1), F.col("head")).alias("head_pos"),
                         F.slice("flags", F.lit(1), F.col("head")).alias("head_flags"), F.element_at("flags", -1).alias("last_flag"),
                         (F.col("head") == F.size("pos")).alias("whole"), F.substring("text", F.lit(1), F.col("size")).alias("head_text"))
    # a document's heads come together and in order, many documents to a task
    tails = cut_lineage(heads.repartition("_row").sortWithinPartitions("_row", "_frag").mapInPandas(_tails, TAIL_SCHEMA))
    maps = frags.drop("text").join(tails.drop("tail_text"), ["_row", "_frag"]).mapInPandas(_maps, MAP_SCHEMA)
    entries = maps.repartition("_row").sortWithinPartitions("_row", "_frag").mapInPandas(_entries, ENTRY_SCHEMA)
    chunks = cut_lineage(frags.join(tails, ["_row", "_frag"]).join(entries, ["_row", "_frag"])
                         .mapInPandas(_chunks, CHUNK_SCHEMA))
    counts = chunks.groupBy("_row", "_frag").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("_row").orderBy("_frag").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_row", "_frag", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    return (chunks.join(before, ["_row", "_frag"]).join(base.select("_row", "_keep"), "_row")
            .select("_keep.*", (F.col("_before") + F.col("_k")).cast("int").alias("chunk_index"), "chunk_text"))
