"""Cross-tokenizer alignment with an associative fragment monoid.

Two tokenizers cut the same bytes (a blank and the text) differently. Offsets where tokens of both end
close a group; a group's last tokens end together and are a link.

A `Fragment` is what a byte range knows by itself: the open prefix (ids of tokens that end in the range up
to its first common end), the closed groups, and the open suffix (ids after its last common end).
`Fragment.then` joins two neighbouring ranges: the left one's suffix and the right one's prefix close
one group. It is associative, and `EMPTY` is its unit, so ranges of a document can be joined in any tree.

* A document of up to `CHUNK` characters is one range, closed on both sides; a batch of them is aligned at once.
* A longer document is cut into chunks that all tasks share, before blanks that stand between two other characters
  (in both vocabularies a blank only begins a token, so no token reaches over one). The byte ranges (`RANGE`) of a chunk are
  fragments joined in a tree, and a tree of tasks joins `FAN` neighbouring chunks at a time; groups
  that close on the way leave as rows. The digest is taken over a document's groups in order, streamed.
* Links are counted per document, per pair of ids over the corpus (map-side first) and per id of the second tokenizer.
  Pairs that make up 2^-`HOT_BITS` of all links or more, so at most 2^`HOT_BITS` pairs, are sent to all tasks and looked up
  there; only the links of the others are joined by a shuffle. So no pair is hot in that join.

Defined cases: null and empty texts, and texts whose tokens' joined bytes differ from a blank and the text, have no
tokens: zeros and an empty digest, and they count no link; null or repeated doc_ids: every row is aligned for itself; very
long texts: as above, a text without blanks is one run and is encoded by one task; empty table: empty
result; only doc_id and text are read, so further columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .packing import vocabulary_path

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
CHUNK = 1 << 16
FAN = 8
RANGE = 1 << 12
HOT_BITS = 18
_CUT = re.compile(r"(?<=\S)(?= \S)")


# --------------------------------------------------------------------------- fragments
@dataclass(frozen=True)
class Fragment:
    """n_a, n_b tokens end in the range; without a common end (`cut` false) all of them are in the prefix.

    groups: texts of closed groups (`a1,a2|b1`); links: their codes, first id << 32 | second id.
    """
    n_a: int = 0
    n_b: int = 0
    cut: bool = False
    prefix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    groups: tuple[str, ...] = ()
    links: tuple[int, ...] = ()
    suffix: tuple[tuple[int, ...], tuple[int, ...]] = ((), ())
    ok: bool = True

    def then(self, right: Fragment) -> Fragment:
        ok, n_a, n_b = self.ok and right.ok, self.n_a + right.n_a, self.n_b + right.n_b
        if not self.cut:
            return replace(right, ok=ok, n_a=n_a, n_b=n_b, prefix=_joined(self.prefix, right.prefix))
        if not right.cut:
            return replace(self, ok=ok, n_a=n_a, n_b=n_b, suffix=_joined(self.suffix, right.prefix))
        texts, links = _closed(_joined(self.suffix, right.prefix))
        return Fragment(n_a, n_b, True, self.prefix, self.groups + texts + right.groups, self.links + links + right.links, right.suffix, ok)

    def finished(self) -> Fragment:
        """The fragment of a whole run or document: its prefix is a group too."""
        texts, links = _closed(self.prefix)
        return replace(self, prefix=((), ()), groups=texts + self.groups, links=links + self.links)


EMPTY = Fragment()


def _joined(x, y):
    return x[0] + y[0], x[1] + y[1]


def _closed(group) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """Text and link of a group, none of an empty one (where a range begins with a common end)."""
    a, b = group
    if not a and not b:
        return (), ()
    return (",".join(map(str, a)) + "|" + ",".join(map(str, b)),), ((a[-1] << 32 | b[-1],) if a and b else ())


def fragments(a: list[int], b: list[int], ends_a: np.ndarray, ends_b: np.ndarray, size: int = RANGE) -> Iterator[Fragment]:
    """One fragment per byte range (k * size, (k + 1) * size], of the tokens that end in it."""
    both = np.intersect1d(ends_a, ends_b)
    last = max(int(ends_a[-1]) if len(ends_a) else 0, int(ends_b[-1]) if len(ends_b) else 0)
    for low in range(0, last, size):
        at = both[np.searchsorted(both, low, "right"):np.searchsorted(both, low + size, "right")]
        stops = [low, *at.tolist(), low + size]
        ia, ib = (np.searchsorted(e, stops, "right").tolist() for e in (ends_a, ends_b))
        parts = [(tuple(a[ia[k]:ia[k + 1]]), tuple(b[ib[k]:ib[k + 1]])) for k in range(len(stops) - 1)]
        n_a, n_b = ia[-1] - ia[0], ib[-1] - ib[0]
        if not len(at):
            yield Fragment(n_a, n_b, False, parts[0])
            continue
        closed = [_closed(p) for p in parts[1:-1]]
        yield Fragment(n_a, n_b, True, parts[0], tuple(t for c in closed for t in c[0]), tuple(x for c in closed for x in c[1]), parts[-1])


def in_tree(parts: list[Fragment]) -> Fragment:
    """Neighbours joined two by two until one fragment is left."""
    while len(parts) > 1:
        parts = [reduce(Fragment.then, parts[i:i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


# --------------------------------------------------------------------------- encoding
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Aligned texts, a batch at a time (numpy over all tokens of the batch)."""

    def __init__(self, first: str, second: str):
        import json

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        byte, vocab = _byte_of(), json.load(open(first, encoding="utf-8"))
        special = {t["content"] for t in vocab["added_tokens"]}
        self.bytes_a = {i: bytes(byte[c] for c in piece) for piece, i in vocab["model"]["vocab"].items() if piece not in special}
        # ids of this vocabulary are the order of its merges, so they serve as ranks
        self.first = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes_a.items()}, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the second vocabulary has pieces that reach over a blank")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = max(self.bytes_a) + 1, len(pieces)
        self.length_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(self.size_a)])
        self.length_b = np.array([len(b) for b in self.bytes_b])
        # an id and the sign behind it: the first tokenizer's within and at the end of a group, then the second's
        self.signs = [f"{i}{sign}".encode() for n, signs in ((self.size_a, ",|"), (self.size_b, ",;")) for sign in signs for i in range(n)]

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of each text by both tokenizers, and whether both are the bytes of blank + text; else (and for empty texts) no ids."""
        a, b, ok = [], [], []
        for text, ids in zip(texts, self.second.encode(texts, num_threads=1), strict=True):
            raw = " " + text
            mine = self.first.encode_ordinary(raw) if text else []
            raw = raw.encode()
            ok.append(not text or (b"".join(map(self.bytes_b.__getitem__, ids)) == raw and b"".join(map(self.bytes_a.__getitem__, mine)) == raw))
            a.append(mine if ok[-1] else [])
            b.append(ids if ok[-1] and text else [])
        return a, b, ok

    def __call__(self, texts: list[str]) -> list[tuple[int, int, int, np.ndarray, bytes, bool]]:
        """n_a, n_b, n_groups, links, groups' text and ok of each text: the finished fragments of all texts at once."""
        a, b, ok = self.encoded(texts)
        n_a, n_b = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        # both cover the same bytes, so ends counted over the whole batch can be compared
        ends_a, ends_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(0, dtype=bool)
        last_b = np.zeros(len(flat_b), dtype=bool)
        last_b[at[last_a]] = True
        stop_a, stop_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        links = flat_a[stop_a] << 32 | flat_b[stop_b]
        # groups in order, in each the first tokenizer's ids before the second's
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(flat_a) + len(flat_b), dtype=np.int64)
        codes[np.arange(len(flat_a)) + np.concatenate([[0], stop_b + 1])[group_a]] = flat_a + last_a * self.size_a
        codes[np.arange(len(flat_b)) + (stop_a + 1)[group_b]] = 2 * self.size_a + flat_b + last_b * self.size_b
        signs = list(map(self.signs.__getitem__, codes.tolist()))
        places = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        bounds = np.searchsorted(stop_a, np.concatenate([[0], np.cumsum(n_a)])).tolist()
        return [(int(n_a[i]), int(n_b[i]), bounds[i + 1] - bounds[i], links[bounds[i]:bounds[i + 1]], b"".join(signs[places[i]:places[i + 1]])[:-1], ok[i])
                for i in range(len(texts))]

    def fragment(self, text: str, size: int = RANGE) -> Fragment:
        """The fragment of a chunk, joined from those of its byte ranges."""
        (a,), (b,), (ok,) = self.encoded([text])
        if not ok:
            return Fragment(ok=False)
        return in_tree(list(fragments(a, b, np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), size)))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    """One per worker process, which later tasks find again."""
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _sliced(lengths: list[int], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` characters."""
    i = 0
    while i < len(lengths):
        j, held = i, 0
        while j < len(lengths) and (j == i or held + lengths[j] <= size):
            held += lengths[j]
            j += 1
        yield i, j
        i = j


def _counted(links: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.array(links, dtype=np.int64), return_counts=True)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_PAIRS = "pairs array<long>, times array<long>"


def _whole(paths: tuple[str, str]):
    """Texts of one chunk: counts, digest, and the document's distinct links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(paths)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in _sliced(list(map(len, texts))):
                n_a, n_b, n_groups, links, groups, _ = zip(*align(texts[i:j]), strict=True)
                pairs = [np.unique(x, return_counts=True) for x in links]
                shas = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(groups, n_a, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_groups)), pa.array(shas, pa.string()),
                     _lists([p for p, _ in pairs], pa.int64()), _lists([n for _, n in pairs], pa.int64())],
                    ["doc_id", *_NUMBERS, "groups_sha256", "pairs", "times"])
    return run


def _cut(chunk: int):
    """Long texts in chunks (seq from 0) that begin where a run does; a text without such places is one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start, seq = 0, 0
                while start < len(text):
                    stop = _CUT.search(text, start + chunk)
                    stop = stop.start() if stop else len(text)
                    # the blank before a chunk is the one that every text gets in front
                    yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([seq], pa.int64()), pa.array([text[start:stop]], pa.string())],
                                                     ["rid", "seq", "text"])
                    start, seq = stop + 1, seq + 1
    return run


_FRAGMENT = "rid long, seq long, place long, ok boolean, cut boolean, n_a long, n_b long, n_groups long, pre_a array<int>, pre_b array<int>, suf_a array<int>, suf_b array<int>"


def _pieces(paths: tuple[str, str]):
    """Chunks as fragments; their closed groups' text and links leave at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(paths)
        for batch in batches:
            rid, seq, texts = (batch.column(c).to_pylist() for c in ("rid", "seq", "text"))
            for i, j in _sliced(list(map(len, texts))):
                found = [align.fragment(t) for t in texts[i:j]]
                pairs = [_counted(f.links) for f in found]
                open_ = [[side[k] for side in (f.prefix, f.suffix) for k in (0, 1)] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[i:j], pa.int64()), pa.array(seq[i:j], pa.int64()), pa.array([2 * s for s in seq[i:j]], pa.int64()),
                     pa.array([f.ok for f in found]), pa.array([f.cut for f in found]),
                     *(pa.array(c, pa.int64()) for c in ([f.n_a for f in found], [f.n_b for f in found], [len(f.links) for f in found])),
                     *(pa.array([o[k] for o in open_], pa.list_(pa.int32())) for k in range(4)),
                     pa.array([";".join(f.groups) for f in found], pa.string()), _lists([p for p, _ in pairs], pa.int64()), _lists([n for _, n in pairs], pa.int64())],
                    [c.split()[0] for c in _FRAGMENT.split(", ")] + ["text", "pairs", "times"])
    return run


def _fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Up to FAN neighbouring fragments joined to one; groups that close between them are rows of their own (text set).

    place: where a group that closes at the fragment's first common end belongs in the document's order
    """
    rows = rows.sort_values("seq")
    total, place, out = EMPTY, 0, []
    for r in rows.itertuples():
        pre_a, pre_b, suf_a, suf_b = (tuple(map(int, x)) for x in (r.pre_a, r.pre_b, r.suf_a, r.suf_b))
        part = Fragment(r.n_a, r.n_b, r.cut, (pre_a, pre_b), (), (), (suf_a, suf_b), r.ok)
        if part.cut and not total.cut:
            place = r.place
        total = total.then(part)
        for text, link in zip(total.groups, total.links, strict=False):
            out.append((r.place, text, [link]))
        total = replace(total, groups=(), links=())
    first = rows.iloc[0]
    made = pd.DataFrame([(first["rid"], first["seq"], place, total.ok, total.cut, total.n_a, total.n_b, int(rows["n_groups"].sum()) + len(out),
                          *map(list, total.prefix), *map(list, total.suffix), None, None)]
                        + [(first["rid"], first["seq"], p, True, True, 0, 0, 0, [], [], [], [], t, x) for p, t, x in out],
                        columns=[c.split()[0] for c in _FRAGMENT.split(", ")] + ["text", "pairs"])
    return made


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each document's groups; rows (rid, place, text) come sorted."""
    rid, sha = None, None
    for batch in batches:
        for r, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer()
            if r != rid:
                if rid is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([sha.hexdigest()])], ["rid", "groups_sha256"])
                rid, sha = r, hashlib.sha256(raw)
            elif len(raw):
                sha.update(b";")
                sha.update(raw)
    if rid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([sha.hexdigest()])], ["rid", "groups_sha256"])


def _long(scratch: Scratch, docs: DataFrame, paths: tuple[str, str], chunk: int) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, counts, digest) of long documents and (rid, pairs, times) of their parts."""
    named = scratch.keep(docs.withColumn("rid", -F.monotonically_increasing_id() - 1), "long")
    parts = (named.select("rid", "text").mapInArrow(_cut(chunk), "rid long, seq long, text string").repartition("rid", "seq")
             .mapInArrow(_pieces(paths), f"{_FRAGMENT}, text string, {_PAIRS}"))
    parts = scratch.keep(parts, "parts")
    columns = [c.split()[0] for c in _FRAGMENT.split(", ")]
    texts = parts.select("rid", (F.col("place") + 1).alias("place"), "text")
    links = parts.select("rid", "pairs", "times")
    level, span = parts.select(*columns), 1
    most = parts.agg(F.max("seq")).first()[0] or 0                       # one number
    while span <= most:
        span *= FAN
        folded = scratch.keep(level.groupBy("rid", F.expr(f"seq div {span}")).applyInPandas(_fold, f"{_FRAGMENT}, text string, pairs array<long>"), "folded")
        closed = folded.filter("text IS NOT NULL")
        texts = texts.unionByName(closed.select("rid", "place", "text"))
        links = links.unionByName(closed.select("rid", "pairs", F.array(F.lit(1).cast("long")).alias("times")))
        level = folded.filter("text IS NULL").select(*columns)
    # a document begins at a common end, so its prefix is its first group
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    has = F.size("pre_a") > 0
    texts = texts.unionByName(level.filter(has).select("rid", "place", F.concat(ids("pre_a"), F.lit("|"), ids("pre_b")).alias("text")))
    first_link = F.shiftleft(F.element_at("pre_a", -1).cast("long"), 32).bitwiseOR(F.element_at("pre_b", -1).cast("long"))
    links = links.unionByName(level.filter(has).select("rid", F.array(first_link).alias("pairs"), F.array(F.lit(1).cast("long")).alias("times")))
    heads = level.select("rid", "ok", "n_a", "n_b", (F.col("n_groups") + has.cast("long")).alias("n_groups"))
    good = heads.filter("ok").select("rid")
    shas = (texts.filter("text <> ''").join(good, "rid", "left_semi").repartition("rid").sortWithinPartitions("rid", "place").select("rid", "text")
            .mapInArrow(_digests, "rid long, groups_sha256 string"))
    zero = lambda c: F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c)
    heads = (named.select("rid", "doc_id").join(heads, "rid").join(shas, "rid", "left")
             .select("rid", "doc_id", zero("n_a"), zero("n_b"), zero("n_groups"), F.when(F.col("ok"), F.col("n_groups")).otherwise(0).alias("n_links"),
                     F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    return heads, links.join(good, "rid", "left_semi")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n, best of every pair of ids over (pairs, times) rows; best: no other pair of its second id is more frequent."""
    pairs = (links.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
             .withColumn("second", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    top = pairs.groupBy("second").agg(F.max("n").alias("top"))
    return pairs.join(top, "second").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def _scored(hot) -> object:
    """count_sum and n_best over a row's hot pairs; the others stay in the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = hot.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            at = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            p, t = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            k = np.minimum(np.searchsorted(codes, p), max(len(codes) - 1, 0))
            known = codes[k] == p if len(codes) else np.zeros(len(p), dtype=bool)
            total = lambda x, at=at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            sums = [total(np.where(known, t * v[k], 0) if len(codes) else np.zeros(len(p), np.int64)) for v in (n, best)]
            left = np.concatenate([[0], np.cumsum(~known)])[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), *(pa.array(s, pa.int64()) for s in sums),
                 *(pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~known], pa.int64())) for x in (p, t))],
                ["rid", "count_sum", "n_best", "pairs", "times"])
    return run


def align(docs: DataFrame, first: str | None = None, second: str | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, and the corpus-wide pair counts."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    paths = (first or vocabulary_path(FIRST), second or vocabulary_path(SECOND))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    docs = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = scratch.keep(docs.filter(~is_long).mapInArrow(_whole(paths), f"doc_id {kind}, {numbers}, groups_sha256 string, {_PAIRS}")
                         .withColumn("rid", F.monotonically_increasing_id()), "short")
    heads, links = short.drop("pairs", "times"), short.select("rid", "pairs", "times")
    more = docs.filter(is_long)
    if not more.isEmpty():
        long_heads, long_links = _long(scratch, more, paths, chunk)
        heads, links = heads.unionByName(long_heads), links.unionByName(scratch.keep(long_links, "long-links"))
    counts = scratch.keep(pair_counts(links), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0                       # one number
    is_hot = F.col("n") >= F.lit(total / (1 << HOT_BITS))
    hot = counts.filter(is_hot).toPandas().sort_values("pair")            # at most 2^HOT_BITS rows, as their counts add up to `total` at most
    sent = spark.sparkContext.broadcast(tuple(hot[c].to_numpy(dtype=np.int64) for c in ("pair", "n", "best")))
    scored = scratch.keep(links.mapInArrow(_scored(sent), f"rid long, count_sum long, n_best long, {_PAIRS}"), "scored")
    rest = (scored.filter(F.size("pairs") > 0).select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), "x.times")
            .join(counts.filter(~is_hot), "pair").select("rid", (F.col("times") * F.col("n")).alias("count_sum"), (F.col("times") * F.col("best")).alias("n_best")))
    sums = scored.select("rid", "count_sum", "n_best").unionByName(rest).groupBy("rid").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = heads.join(sums, "rid", "left").select("doc_id", *_NUMBERS, F.coalesce("n_best", F.lit(0)).alias("n_best"),
                                                 F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
    return out, counts


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0].withColumn("doc_id", F.col("doc_id").cast("long"))
