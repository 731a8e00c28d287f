"""One tokenisation of a document for all its chunks.

Chunks overlap, and every strategy cuts the same document again. A chunk is a range of the
document's characters, so its tokens are a range of the document's tokens plus at most two
words that its ends cut. The document is lower-cased, tokenised and hashed once (its rows, one per
strategy, come together and share the result); a chunk costs two searches and a count over its range.

Runs with the cut into leaves and the merge walk in one Arrow UDF: the walk knows the ranges. Texts go to the
worker once per (document, strategy), and no piece smaller than a part of a chunk comes back.
"""

from __future__ import annotations

import hashlib
import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise.operators.merge_walk import leaf_codes, walk_document

_WORD = re.compile(r"\w{2,}")          # the vectoriser's tokens, as functions.text.TOKEN_PATTERN
# Capitals whose lower case depends on their neighbours (sigma) or is longer (dotted I): with one of them
# the lower case of a chunk need not be a part of the document's, so chunks are tokenised by themselves.
CONTEXT_CAPITALS = ("Σ", "İ")


@lru_cache(maxsize=1)
def _word_characters() -> np.ndarray:
    """By code point, whether `re` takes it for a word character."""
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for m in re.finditer(r"\w+", "".join(map(chr, range(len(table))))):
        table[m.start():m.end()] = True
    return table


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of `_WORD` begin and end, found without a match object for each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = np.zeros(len(points) + 2, dtype=np.int8)
    word[1:-1] = _word_characters()[points]
    turns = np.flatnonzero(np.diff(word))
    starts, ends = turns[::2], turns[1::2]
    some = ends - starts > 1
    return starts[some], ends[some]


class DocumentTokens:
    """Tokens of a text with their places; `spans` finds those of any ranges of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.apart = any(c in text for c in CONTEXT_CAPITALS)
        self.lower = text.lower()
        words = _WORD.findall(self.lower)
        self.ids = {word: i for i, word in enumerate(dict.fromkeys(words))}
        self.tokens = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        self.starts, self.ends = word_places(self.lower)
        self.counts = np.bincount(self.tokens, minlength=len(self.ids))     # by id
        self.of_dims: dict[int, np.ndarray] = {}                            # dims -> bucket of every token

    def spans(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, str]]]:
        """Per range [begin, end): first token, token after the last; and (range, word) of words that the ends cut."""
        if self.apart:
            none = np.zeros(len(begin), dtype=np.int64)
            return none, none, [(k, w) for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist()))
                                for w in _WORD.findall(self.text[a:b].lower())]
        n, words = len(self.starts), []
        if not n:
            none = np.zeros(len(begin), dtype=np.int64)
            return none, none, words
        first = np.searchsorted(self.starts, begin, "left")
        after = np.searchsorted(self.ends, end, "right")
        before, behind = np.maximum(first - 1, 0), np.minimum(after, n - 1)
        for k in np.flatnonzero((first > 0) & (self.ends[before] > begin)).tolist():       # a word that begins before the range
            words.append((k, self.lower[begin[k]:min(self.ends[before[k]], end[k])]))
        starts = self.starts[behind]
        for k in np.flatnonzero((after < n) & (begin <= starts) & (starts < end)).tolist():     # a word that ends behind it
            words.append((k, self.lower[starts[k]:end[k]]))
        return first, np.maximum(first, after), [(k, w) for k, w in words if len(w) > 1]

    def buckets(self, dims: int) -> np.ndarray:
        if dims not in self.of_dims:
            self.of_dims[dims] = np.array([token_bucket(t, dims) for t in self.ids], dtype=np.int64)[self.tokens]
        return self.of_dims[dims]

    def bucket_counts(self, begin: np.ndarray, end: np.ndarray, dims: int) -> np.ndarray:
        """Tokens per range and bucket."""
        first, after, words = self.spans(begin, end)
        row, at = within(first, after)
        out = np.bincount(row * dims + self.buckets(dims)[at], minlength=len(begin) * dims).astype(float)
        for k, word in words:
            out[k * dims + token_bucket(word, dims)] += 1
        return out.reshape(-1, dims)


def within(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (range, index) with first[range] <= index < after[range]."""
    sizes = after - first
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


@lru_cache(maxsize=1 << 18)           # above the words that a corpus' documents share; about 60 MB when full
def token_bucket(token: str, dims: int) -> int:
    """retrieval.token_buckets of one token."""
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dims


def kept_ranges(base: str, codes, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The walk's (start, end, strip) rows of chunks that are not empty, and where these begin and end in `base`."""
    codes = np.asarray(codes, dtype=np.int64)
    rows = np.array(walk_document(codes, size, overlap), dtype=np.int64).reshape(-1, 3)
    places = np.concatenate(([0], np.cumsum(codes >> 12)))
    begin, end = places[rows[:, 0]], places[rows[:, 1]]
    keep = np.array([not strip or not base[a:b].isspace() for a, b, strip in
                     zip(begin.tolist(), end.tolist(), rows[:, 2].tolist())], dtype=bool) & (end > begin)
    return rows[keep], begin[keep], end[keep]


class LastTokens:
    """The tokens of the last text; rows of one document stand together."""

    def __init__(self):
        self.text, self.tokens = None, None

    def of(self, text: str) -> DocumentTokens:
        if self.tokens is None or text != self.text:
            self.text, self.tokens = text, DocumentTokens(text)
        return self.tokens


def walked(shapes: list, texts: pa.Array, shape: pa.Array, pieces: pa.Array, codes: pa.Array, size: pa.Array, overlap: pa.Array):
    """Per row (text, what its leaves tile, the walk's rows, their begins and ends), or None where there is no leaf.

    shapes: the separators of each built-in shape; a row without one brings the leaves of a registered splitter.
    """
    for k, text in enumerate(texts):
        text, s = text.as_py(), shape[k].as_py()
        if s is None:
            base, leaves = pieces[k].as_py(), codes[k].as_py()
        else:
            base, leaves = text, leaf_codes(text or "", shapes[s], size[k].as_py())
        yield (text, base, *kept_ranges(base, leaves, size[k].as_py(), overlap[k].as_py())) if leaves else None


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    at = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def walk_pieces(shapes: list, dims: int | None = None):
    """UDF (text, shape, pieces joined, codes, size, overlap) -> the text cut where chunks begin and end, the chunks as
    (first piece, piece after the last, strip); with `dims` also their vectors, `dims` numbers each.

    The vectors are those of `retrieval.with_lexical_embedding`.
    """
    def run(texts: pa.Array, shape: pa.Array, given: pa.Array, codes: pa.Array, size: pa.Array, overlap: pa.Array) -> pa.Array:
        last, at, pieces, ranges, vectors = LastTokens(), [0], [], [], []
        for row in walked(shapes, texts, shape, given, codes, size, overlap):
            places = np.zeros(0, dtype=np.int64) if row is None else np.unique(np.concatenate(row[3:]))
            if len(places):
                _, base, rows, begin, end = row
                cuts = places.tolist()
                pieces += [base[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                ranges.append(np.stack([np.searchsorted(places, begin), np.searchsorted(places, end), rows[:, 2]], axis=1).ravel())
            else:
                ranges.append(places)
            at.append(len(pieces))
            if dims:
                out = last.of(base).bucket_counts(begin, end, dims) if len(places) else np.zeros((0, dims))
                norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
                np.divide(out, norm, out=out, where=norm > 0)
                vectors.append(out.ravel())
        columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pieces, pa.string())), _lists(ranges, pa.int32())]
        return pa.StructArray.from_arrays(columns + ([_lists(vectors, pa.float64())] if dims else []), ["pieces", "ranges", "vectors"][:3 if dims else 2])

    fields = [T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("ranges", T.ArrayType(T.IntegerType()))]
    if dims:
        fields.append(T.StructField("vectors", T.ArrayType(T.DoubleType())))
    # filters on the chunks must not be pushed below the walk: the optimizer would copy it into them
    return F.arrow_udf(run, T.StructType(fields)).asNondeterministic()
