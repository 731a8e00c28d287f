"""Greedy merge of adjacent pieces into chunks (C1, and C2 within a run).

The walk stays in Python, and with it the cut into leaves (`leaf_codes`): cut natively, a text becomes a
struct per word in interpreted lambdas, which took most of a chunking query's time. The
start of chunk t+1 depends on where chunk t ended, a data-dependent recurrence
that native array functions can only state with an O(k^2) array append per
document, or with a shuffle of every piece plus pointer jumping. Here it runs
once per document, O(k log n), on the leaves' int codes.

Input per document: one int64 code per leaf, in document order (leaves tile
the text): code-point length * 4096 + flags, flags = depth*4 + good*2 + first_child.
A good leaf joins the merge run of its predecessor when the predecessor is a
good leaf of the same parent; every other good leaf starts a new run. A leaf
that is not good is emitted whole and unstripped.

Output: flat int array of triples (start, end, strip): ranges of leaves, in
document order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_run(cs: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [s, e) over the pieces of one run; cs are prefix lengths (cs[0] == 0)."""
    m = len(cs) - 1
    out = []
    s = 0
    while True:
        t = bisect_right(cs, cs[s] + size)          # first prefix beyond the budget
        i = max(t - 1, s + 1)                       # piece that no longer fits
        if i >= m:
            out.append((s, m))
            return out
        out.append((s, i))
        # carry whole pieces worth <= overlap, and leave room for piece i
        s = min(i, bisect_left(cs, max(cs[i] - overlap, cs[i + 1] - size)))


def walk_document(leaves, size: int, overlap: int) -> list[int]:
    """Run boundaries and prefix sums with numpy; Python loops only over runs and chunks.

    leaves: int64 codes length * 4096 + flags (flags = depth*4 + good*2 + first).
    """
    n = len(leaves)
    if n == 0:
        return []
    codes = np.asarray(leaves, dtype=np.int64)
    ln = codes >> 12
    fl = codes & 4095
    good = (fl & 2) != 0
    depth = fl >> 2
    starts = np.ones(n, dtype=bool)
    starts[1:] = ~good[1:] | ~good[:-1] | ((fl[1:] & 1) != 0) | (depth[1:] != depth[:-1])
    bounds = np.flatnonzero(starts).tolist() + [n]
    offsets = np.concatenate(([0], np.cumsum(ln)))
    out: list[int] = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if not good[a]:                              # oversize leaf: emitted whole, unstripped
            out += (a, b, 0)
            continue
        cs = (offsets[a:b + 1] - offsets[a]).tolist()
        for s, e in merge_run(cs, size, overlap):
            out += (a + s, a + e, 1)
    return out


def leaf_codes(text: str, separators: list[str] | None, size: int) -> list[int]:
    """Codes of the leaves of a text: the line splitter's pieces (separators None), or the recursive splitter's.

    The same leaves as `chunking.line_leaves` and `chunking.recursive_leaves_sql`; only lengths and flags are kept.
    """
    codes: list[int] = []

    def separator(part: str, level: int) -> int:
        """The first separator from `level` on that occurs; the last one when none does."""
        return next((c for c in range(level, len(separators)) if separators[c] in part), len(separators) - 1)

    def cut(part: str, level: int, depth: int) -> None:
        sep, flags = separators[level], depth * 4
        if sep:
            pieces = part.split(sep)
            lengths = [len(p) + len(sep) for p in pieces]
            lengths[0] -= len(sep)
            if not lengths[0]:
                lengths = lengths[1:]
        else:
            lengths = [1] * len(part)
        first = 1
        if max(lengths) < size:
            codes.extend([(n << 12) + flags + 2 for n in lengths])
            codes[-len(lengths)] += 1
            return
        at = 0
        for n in lengths:
            if n < size:
                codes.append((n << 12) + flags + 2 + first)
            elif level + 1 < len(separators):
                piece = part[at:at + n]
                cut(piece, separator(piece, level + 1), depth + 1)
            else:
                codes.append((n << 12) + flags + first)
            at, first = at + n, 0

    if text and separators is None:
        lengths = [len(p) + 1 for p in text.split("\n")]
        lengths[0] -= 1
        codes = [(n << 12) + 2 for n in lengths if n]
    elif text:
        cut(text, separator(text, 0), 1)
    return codes


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def merge_ranges(leaves: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([
        walk_document(lv if lv is not None else [], int(sz), int(ov))
        for lv, sz, ov in zip(leaves, size, overlap)
    ])


# Filters on the chunks (such as the one that `explode` infers) must not be pushed below the walk:
# the optimizer would copy it into them.
merge_ranges = merge_ranges.asNondeterministic()


try:  # ship this module by value so executors need not have the package installed
    from pyspark import cloudpickle as _cp
    import sys as _sys
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover
    pass
