"""Exact n-gram Jaccard join with token-combination prefixes.

A document's set are its distinct shingles (`width` words); two documents link when
100 * |both| >= similarity * |either|. Equal sets (by a 128-bit digest) are one representative.

1. A count of all tokens (shingles) of all documents goes into 2^`SKETCH_BITS` counters, summed by tasks; tokens
   are ordered by (log of their counter, hash), rare ones first. The counter also gives the token's
   class k: 1 (rare), 2 or 3 (frequent). Collisions only move a token within this order, never lose a link.
2. A linked pair differs in at most D = floor(n * (100 - similarity) / similarity) tokens, seen from either side.
   A prefix is the shortest start of the ordered set with c_1 + ceil((c_2 - 1) / 2) + ceil((c_3 - 2) / 3) > D, where
   c_k of its tokens are of class k. Its signatures are single tokens of class 1, and
   combinations of k neighbouring tokens of class k (neighbours among the set's tokens of that class). One differing token undoes at
   most k combinations, so D of them leave one that both sides hold: of two prefixes the one that ends
   first in the common order has all its tokens within reach of the other.
3. Representatives that share a signature are candidates. In lists longer than `SMALL` each member meets `PIVOTS`
   pivots; in its shorter ones it meets up to `PIVOTS` members in all, however many
   it shares a list with; then all pairs of the shorter lists meet but those that are connected by now, and one pair of any two
   clusters goes on; last, members outside a long list's largest cluster meet all its members, block by block.
   A candidate must pass a bound on full sets: both sides' tokens counted in about n / 4 buckets, the
   overlap is at most the sum of the smaller counts.
4. Verification: candidates' clusters meet in blocks on their full shingle sets, computed from the whole texts. In a
   block all pairs are compared by an inverted index and only links that join
   components are emitted; what the blocks of one cluster keep apart is compared again, blockwise. So
   a group of copies costs rows in proportion to its size, and no link between components is given up.

The counters are the only broadcast (one byte each, 4 MB whatever the input); sets,
lists, links and components stay distributed.

Defined cases: null, empty or blank texts have no shingles and stand alone; a text of fewer words than a
shingle is its only shingle; repeated rows and ids are copies; null ids are never the smallest unless a component
has no other; very long texts are read whole, and blocks are bounded by their tokens as well as their members;
empty table: empty result; only doc_id and text are read, so further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .near_dedup import _families, _named, _ordered, _pairs_frame, _stars, _stragglers, components

SKETCH_BITS = 22
_SLOTS = 64
SMALL = 16
PIVOTS = 3
#: A block's bounds: members, and tokens of their sets (8 bytes each).
BLOCK = 512
BLOCK_TOKENS = 4 << 20
BLOCK_PIVOTS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --------------------------------------------------------------------------- token order
def _counter(tokens: np.ndarray, bits: int) -> np.ndarray:
    return ((tokens * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(width: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import Powers, shingle_sets
        powers, counts, held, n_held = Powers(), np.zeros(1 << bits, dtype=np.int64), [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text"), powers, width):
                held.append(s)
                n_held += len(s)
                if n_held > 1 << 20:
                    counts += np.bincount(_counter(np.concatenate(held), bits), minlength=len(counts))
                    held, n_held = [], 0
        if n_held:
            counts += np.bincount(_counter(np.concatenate(held), bits), minlength=len(counts))
        kind = "<u2" if counts.max() < 1 << 16 else "<i8"
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLOTS), pa.int32()), pa.array([p.astype(kind).tobytes() for p in np.split(counts, _SLOTS)], pa.binary())],
                                         ["slot", "counts"])
    return counted


def _added(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per slot 2 * log2 of the summed counters (one byte each) and their sum."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = (1 << bits) // _SLOTS, {}
        for batch in batches:
            for slot, raw in zip(batch.column("slot").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<i8").astype(np.int64)
                total[slot] = total.get(slot, 0) + part
        codes = [(2 * np.log2(np.maximum(t, 1))).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(codes, pa.binary()),
                                          pa.array([int(t.sum()) for t in total.values()], pa.int64())], ["slot", "codes", "n"])
    return added


class Order:
    """The common order of tokens: a byte per counter, and the bytes from which class 2 and class 3 begin."""

    def __init__(self, codes: bytes, total: int, classes: int):
        self.codes, self.bits = np.frombuffer(codes, dtype=np.uint8), len(codes).bit_length() - 1
        usual = 2 * np.log2(4 * total / len(self.codes) + 32)      # well above what unrelated tokens add up to
        self.cuts = [int(usual) + 8 * k if k < classes - 1 else 255 for k in range(2)]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        return np.sort(self.codes[_counter(tokens, self.bits)].astype(np.uint64) << np.uint64(56) | tokens >> np.uint64(8))

    def classes(self, keys: np.ndarray) -> list[np.ndarray]:
        two, three = np.searchsorted(keys, np.array([c << 56 for c in self.cuts], dtype=np.uint64))
        return [keys[:two], keys[two:three], keys[three:]]


def signatures(order: Order, tokens: np.ndarray, similarity: int) -> np.ndarray:
    """Hashes of the single tokens and token combinations of a set's prefix; ascending and distinct."""
    from .shingles import mixed
    need = len(tokens) * (100 - similarity) // similarity + 1
    if need == 1:
        return tokens[:0]                                  # only equal sets link
    out = []
    for k, part in enumerate(order.classes(order.keys(tokens)), 1):
        part = part[:k * need]
        windows = max(0, len(part) - k + 1)
        if windows:
            h = mixed(part[:windows] + np.uint64(k))
            for i in range(1, k):
                h = mixed(h * _ODD + part[i:i + windows])
            out.append(h)
        need -= -(-windows // k)
        if need <= 0:
            break
    return np.unique(np.concatenate(out)) if out else tokens[:0]


def _classes(similarity: int) -> int:
    """How many token classes any set that can link with another one has enough tokens for."""
    if not 50 < similarity <= 100:
        raise ValueError("similarity must be above 50 and at most 100")
    return 3 if similarity >= 90 else 2 if similarity >= 80 else 1


# --------------------------------------------------------------------------- bound on the overlap
def bucket_counts(tokens: np.ndarray) -> bytes:
    """Tokens counted in a power of two of about n / 4 buckets, a byte each."""
    n = 1 << max(3, (len(tokens) // 4).bit_length())
    return np.minimum(np.bincount((tokens & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def _folded(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of counts in fewer buckets."""
    return counts.reshape(len(counts), -1, buckets).sum(axis=1)


def _possible(a: np.ndarray, n_a, b: np.ndarray, n_b, similarity: int) -> np.ndarray:
    """Rows whose overlap can be large enough; a count of 255 may stand for more, so it decides nothing."""
    buckets = min(a.shape[1], b.shape[1])
    full = (a == 255).any(axis=1) | (b == 255).any(axis=1)
    most = np.minimum(_folded(a.astype(np.int64), buckets), _folded(b.astype(np.int64), buckets)).sum(axis=1)
    most = np.minimum(np.where(full, np.minimum(n_a, n_b), most), np.minimum(n_a, n_b))
    return 100 * most >= similarity * (n_a + n_b - most)


def _rows(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)


def _possible_pairs(similarity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("h_a").to_pylist(), batch.column("h_b").to_pylist()
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            shape: dict = {}
            for i, key in enumerate(zip(map(len, a), map(len, b), strict=True)):
                shape.setdefault(key, []).append(i)
            keep = np.zeros(len(a), dtype=bool)
            for at in shape.values():
                keep[at] = _possible(_rows([a[i] for i in at]), n_a[at], _rows([b[i] for i in at]), n_b[at], similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return possible


def _by_counts(similarity: int):
    def compare(asks: pd.DataFrame, members: pd.DataFrame) -> Iterator[np.ndarray]:
        n, held = members["n"].to_numpy(), members["hist"].to_numpy()
        lengths = np.array([len(x) for x in held])
        parts = [(at, _rows(list(held[at]))) for at in (np.flatnonzero(lengths == k) for k in np.unique(lengths))]
        for raw, m in zip(asks["hist"], asks["n"], strict=True):
            mine, hits = _rows([raw]), np.zeros(len(n), dtype=bool)
            for at, counts in parts:
                hits[at] = _possible(np.broadcast_to(mine, (len(at), mine.shape[1])), m, counts, n[at], similarity)
            yield hits
    return compare


# --------------------------------------------------------------------------- full sets
class _Block:
    """Full sets of a block's members, with an inverted index."""

    def __init__(self, rows: pd.DataFrame, similarity: int):
        self.sets = [np.frombuffer(v, dtype=np.uint64) for v in rows["set"]]
        self.n, self.similarity = np.array([len(x) for x in self.sets]), similarity
        every = np.concatenate(self.sets)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], np.repeat(np.arange(len(self.sets)), self.n)[order]

    def linked(self, x: np.ndarray) -> np.ndarray:
        """Which members are similar enough to the set x."""
        low, high = np.searchsorted(self.every, x, "left"), np.searchsorted(self.every, x, "right")
        size = high - low
        at = np.repeat(high - np.cumsum(size), size) + np.arange(size.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sets))
        return 100 * both >= self.similarity * (len(x) + self.n - both)


def _block_links(similarity: int):
    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links that join the components of a block: every member against all, one link per component met."""
        rep, out, block, top = rows["rep"].to_numpy(), [], _Block(rows, similarity), np.arange(len(rows))
        for i, x in enumerate(block.sets):
            if (top == top[0]).all():
                break
            near = np.flatnonzero(block.linked(x) & (top != top[i]))
            first = near[np.unique(top[near], return_index=True)[1]]
            if len(first):
                out.append(pd.DataFrame({"a": np.minimum(rep[i], rep[first]), "b": np.maximum(rep[i], rep[first])}))
                top[np.isin(top, top[first])] = top[i]
        return _pairs_frame(out)
    return links


def _by_set(similarity: int):
    def compare(asks: pd.DataFrame, members: pd.DataFrame) -> Iterator[np.ndarray]:
        block = _Block(members, similarity)
        return (block.linked(np.frombuffer(v, dtype=np.uint64)) for v in asks["set"])
    return compare


def _blocks(clusters: DataFrame) -> DataFrame:
    """cluster, nb, rep and block of every member (rep, n, cluster); pivots stand in all blocks of their cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")).select(
        "cluster", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int").alias("nb"))
    rows = clusters.join(sizes, "cluster").withColumn("h", F.xxhash64("rep", F.lit(3)))
    rows = rows.withColumn("block", F.pmod("h", F.col("nb")).cast("int"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("h", "rep"))
    pivots = (rows.filter("nb > 1").withColumn("r", rank).filter(F.col("r") <= BLOCK_PIVOTS)
              .select("cluster", "nb", "rep", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block")))
    return rows.select("cluster", "nb", "rep", "block").unionByName(pivots).distinct()


# --------------------------------------------------------------------------- the join
def _signed(width: int, similarity: int, codes, total: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import Powers, digest, shingle_sets
        powers, order = Powers(), Order(codes.value, total, _classes(similarity))
        for batch in batches:
            n, d1, d2, sigs, hist = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), powers, width):
                a, b = digest(s) if len(s) else (0, 0)
                for column, value in zip((n, d1, d2, sigs, hist), (len(s), a, b, signatures(order, s, similarity).view(np.int64), bucket_counts(s)), strict=True):
                    column.append(value)
            at = np.cumsum([0, *map(len, sigs)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                                              lists, pa.array(hist, pa.binary())], ["doc_id", "n", "d1", "d2", "sigs", "hist"])
    return signed


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import Powers, digest, shingle_sets
        powers = Powers()
        for batch in batches:
            rows = [(*digest(s), s.tobytes()) for s in shingle_sets(batch.column("text"), powers, width) if len(s)]
            d1, d2, sets = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sets, pa.binary())], ["d1", "d2", "set"])
    return found


def _list_pairs(similarity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs, of sizes that allow a link and not of one cluster, inside lists of at most SMALL members; rows come sorted by signature."""
    def pairs(sig, rep, n, comp):
        a, b = [], []
        for d in range(1, SMALL):
            at = np.flatnonzero(sig[d:] == sig[:-d]) if len(sig) > d else ()
            if not len(at):
                break
            at = at[(comp[at] != comp[at + d]) & (100 * np.minimum(n[at], n[at + d]) >= similarity * np.maximum(n[at], n[at + d]))]
            a.append(np.minimum(rep[at], rep[at + d]))
            b.append(np.maximum(rep[at], rep[at + d]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        both = np.unique(np.stack([a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("sig", "rep", "n", "comp")]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            last = np.searchsorted(now[0], now[0][-1])        # the last list may go on in the next batch
            left = [x[last:] for x in now]
            yield pairs(*(x[:last] for x in now))
        if left is not None:
            yield pairs(*left)
    return run


def _hooks(rows: DataFrame, similarity: int) -> DataFrame:
    """Of the lists in rows (sig, rep, n) up to PIVOTS pairs per rep, of sizes that allow a link: the members it meets whose hashes are smallest."""
    pivots = rows.groupBy("sig").agg(*[F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("h"), "rep", F.col("n").alias("m"))).alias(f"p{i}") for i in range(PIVOTS)])

    def fits(p: str) -> Column:
        m = F.col(f"{p}.m")
        return (F.col(f"{p}.rep") != F.col("rep")) & (100 * F.least("n", m) >= similarity * F.greatest("n", m))

    names = [f"p{i}" for i in range(PIVOTS)]
    met = rows.join(pivots, "sig").groupBy("rep").agg(*[F.min(F.when(fits(p), F.col(p))).alias(p) for p in names])
    pairs = met.select("rep", F.explode(F.array(*[F.col(f"{p}.rep") for p in names])).alias("pivot")).filter("pivot IS NOT NULL")
    return pairs.select(*_ordered("rep", "pivot")).distinct()


def _candidates(scratch: Scratch, reps: DataFrame, similarity: int) -> DataFrame:
    """rep, cluster of every representative with a candidate partner."""
    counts = reps.select("rep", "n", "hist")

    def possible(pairs: DataFrame) -> DataFrame:
        return (pairs.join(counts.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("hist").alias("h_a")), "a")
                .join(counts.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("hist").alias("h_b")), "b")
                .select("a", "b", "n_a", "n_b", "h_a", "h_b").mapInArrow(_possible_pairs(similarity), "a long, b long"))

    rows = reps.select(F.explode("sigs").alias("sig"), "rep", "n")
    sizes = rows.groupBy("sig").agg(F.count("*").alias("size")).filter("size > 1")
    live = scratch.keep(rows.join(sizes, "sig"), "lists")
    dense = live.filter(F.col("size") > SMALL).select(F.col("sig").alias("node"), "rep", "size")
    clusters, has_dense = None, not dense.isEmpty()
    if has_dense:
        least = [F.min(F.struct(F.xxhash64("node", "rep", F.lit(i)), "rep")).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = dense.groupBy("node").agg(*least).select("node", F.explode(F.array(*[F.col(f"p{i}.rep") for i in range(PIVOTS)])).alias("pivot"))
        mine = dense.groupBy("rep").agg(F.max(F.struct("size", "node")).alias("x")).select("rep", "x.node")
        stars = mine.join(pivots, "node").filter("rep <> pivot").select(*_ordered("rep", "pivot"))
        clusters = components(scratch, possible(stars.distinct()))
    few = live.filter(F.col("size") <= SMALL).select("sig", "rep", "n")
    hooks = scratch.keep(possible(_hooks(few, similarity)), "hooks")
    clusters = components(scratch, hooks if clusters is None else _stars(clusters).unionByName(hooks))
    scratch.drop(hooks)
    small = _named(few, clusters).select("sig", "rep", "n", "comp").repartition("sig").sortWithinPartitions("sig")
    pairs = possible(small.mapInArrow(_list_pairs(similarity), "a long, b long").distinct())
    # a pair for each two clusters that are still apart
    for end in ("a", "b"):
        pairs = _named(pairs.withColumnRenamed(end, "rep"), clusters).drop("rep").withColumnRenamed("comp", end)
    pairs = scratch.keep(pairs.select(*_ordered("a", "b")).distinct(), "pairs")
    clusters = components(scratch, _stars(clusters).unionByName(pairs))
    scratch.drop(pairs)
    if has_dense:
        mixed = _stragglers(scratch, dense, clusters)
        more = scratch.keep(_families(scratch, mixed, counts, _by_counts(similarity)), "more")
        if not more.isEmpty():
            clusters = components(scratch, _stars(clusters).unionByName(more))
    scratch.drop(live)
    return clusters.withColumnRenamed("comp", "cluster")


def _wanted_sets(scratch: Scratch, docs: DataFrame, signed: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """rep and its full shingle set, from the texts of documents that bear a member's id and digest."""
    wanted = scratch.keep(members.select("rep").distinct().join(
        signed.select(F.col("rid").alias("rep"), F.col("doc_id").alias("id"), "d1", "d2"), "rep"), "wanted")
    texts = docs.join(wanted.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(width), "d1 long, d2 long, set binary").join(wanted.select("rep", "d1", "d2"), ["d1", "d2"])
    sets = scratch.keep(sets.select("rep", "set").dropDuplicates(["rep"]), "sets")
    scratch.drop(wanted)
    return sets


def _linked(scratch: Scratch, docs: DataFrame, signed: DataFrame, clusters: DataFrame, width: int, similarity: int) -> DataFrame:
    """rep, comp of every representative with a confirmed link."""
    sizes = signed.select(F.col("rid").alias("rep"), "n")
    blocks = scratch.keep(_blocks(clusters.join(sizes, "rep")), "blocks")
    sets = _wanted_sets(scratch, docs, signed, blocks, width)
    links = scratch.keep(blocks.join(sets, "rep").groupBy("cluster", "block").applyInPandas(_block_links(similarity), "a long, b long"), "links")
    component = components(scratch, links)
    large = scratch.keep(blocks.filter("nb > 1").select(F.col("cluster").alias("node"), "rep").distinct(), "large")
    if not large.isEmpty():
        apart = _stragglers(scratch, large, component)
        more = scratch.keep(_families(scratch, apart, sets, _by_set(similarity)), "more")
        if not more.isEmpty():
            component = components(scratch, _stars(component).unionByName(more))
    scratch.drop(sets, blocks, links)
    return component


def jaccard_components(docs: DataFrame, width: int = 3, similarity: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`."""
    spark, classes = docs.sparkSession, _classes(similarity)
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    sums = (docs.select("text").mapInArrow(_counted(width, SKETCH_BITS), "slot int, counts binary").repartition("slot")
            .mapInArrow(_added(SKETCH_BITS), "slot int, codes binary, n long").orderBy("slot").collect())        # 2^SKETCH_BITS bytes
    total = sum(r["n"] for r in sums)
    codes = spark.sparkContext.broadcast(b"".join(r["codes"] for r in sums) or bytes(1 << SKETCH_BITS))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = scratch.keep(docs.mapInArrow(_signed(width, similarity, codes, total), f"doc_id {kind}, n long, d1 long, d2 long, sigs array<long>, hist binary")
                          .withColumn("rid", F.monotonically_increasing_id()), "signed")
    groups = scratch.keep(signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least")), "groups")
    reps = scratch.keep(signed.join(groups.select(F.col("rep").alias("rid")), "rid")
                        .select(F.col("rid").alias("rep"), "n", "sigs", "hist").filter(F.size("sigs") > 0), "reps")
    clusters = _candidates(scratch, reps, similarity)
    component = _linked(scratch, docs, signed, clusters, width, similarity)
    named = _named(groups.select("d1", "d2", "rep", "least"), component)
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "comp").select("d1", "d2", "component_id", F.lit(True).alias("in_set"))
    out = (signed.select("doc_id", "n", "d1", "d2").join(known, ["d1", "d2"], "left")
           .select("doc_id", F.col("n").alias("n_shingles"),
                   F.when((F.col("n") > 0) & F.col("in_set"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    out = scratch.keep(out, "out")
    scratch.drop(signed, groups, reps)
    codes.unpersist()
    return out


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, similarity=90)


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM words WHERE len(w) > 2
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) IN (1, 2)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM common JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y WHERE 100 * n_common >= 90 * (sx.n + sy.n - n_common)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""
