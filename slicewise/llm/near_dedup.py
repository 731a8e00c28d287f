"""MinHash near-deduplication by a chosen-path set similarity join.

A document's set are its distinct shingles of `width` words (2 in op9, 5 in the pipeline). Equal sets (by a 128-bit digest)
become one representative, so exact copies never meet. Each representative
has `TOKENS` minwise tokens.

Chosen paths: each of `TREES` trees starts with all representatives in
its root. A node picks `BRANCHES` token positions by a hash of its own name, and sends
each member to one child per position, named by position and the member's token there. Two
sets of similarity J stay together in a child with probability J per position; at
J = 0.8 and two positions a pair survives any depth of one tree with probability
0.9375 at least (1 - q for q = (0.2 + 0.8 q)^2). The trees share the minwise tokens, so their misses are
not independent: averaged over the equal tokens all four miss such a pair with probability of about 1.7e-4, nearer
pairs far less often.

Recursion ends in small nodes (up to `SMALL` members), which are compared exhaustively, token
vector by token vector (4 bits a token); pairs with at least `AGREE` equal tokens (a pair of J = 0.8 has
fewer with probability about 1e-5) are candidates. A node that a branching hardly made smaller
(or of depth `MAX_DEPTH`) is dense: its members are alike, and each is compared with `PIVOTS` pivots.
Documents that candidates connect form a cluster. Dense nodes that hold several clusters make up the family
of their largest one, in which each straggler (a member outside that cluster) is compared
with all members, block by block; a candidate joins the two clusters.

Clusters are confirmed on the full shingle sets, computed again from the texts of their
documents. The sets of a cluster meet in
blocks of about `BLOCK`, so each set travels once and not once per pair; inside a block all pairs are
compared (through an inverted index) and only links that join components are emitted. A
larger cluster has several blocks, each with the same pivots, so a group of copies becomes one
component but for stragglers, which are then compared with all members of their cluster, again
in blocks. So a group of copies costs rows in proportion to
its size and stragglers, and no link between components is given up. Components come from alternating large-star and small-star
rounds; links, components and sets stay distributed.

Defined cases: null, empty or blank texts have no shingles and stand alone; a text of fewer
words than a shingle is its only shingle; repeated rows and ids are copies; null
ids are never the smallest unless a component has no other; empty table: empty
result; only doc_id and text are read, so further columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, located, table

TOKENS = 64
TREES = 4
BRANCHES = 2
SMALL = 32
AGREE = 38
MAX_DEPTH = 8
#: A node with more than this share of its parent's members counts as hardly smaller.
ALIKE = 0.7
PIVOTS = 3
#: Members of a cluster, or members and stragglers of a family, that share a task.
BLOCK = 512
BLOCK_PIVOTS = 16
#: Ids up to this number (8 bytes each) are broadcast to pick texts in the scan; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1 << 20
SIMILARITY = 80          # per cent


def _signed(width: int, passed: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Set size, digest and tokens of every text, behind the columns `passed`."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import MinHash, Powers, digest, shingle_sets
        powers, tokens = Powers(), MinHash(TOKENS)
        for batch in batches:
            n, d1, d2, sig, brief = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), powers, width):
                n.append(len(s))
                a, b = digest(s) if len(s) else (0, 0)
                d1.append(a)
                d2.append(b)
                sig.append(tokens(s) if len(s) else None)
                brief.append(_brief(sig[-1]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), pa.array(n, pa.int64()), pa.array(d1, pa.int64()),
                                              pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), pa.array(brief, pa.binary())],
                                             [*passed, "n", "d1", "d2", "sig", "brief"])
    return signed


def _brief(sig: bytes) -> bytes:
    """4 bits of every token, two to a byte."""
    low = np.frombuffer(sig, "<u2") & 15
    return (low[::2] << 4 | low[1::2]).astype(np.uint8).tobytes()


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import Powers, digest, shingle_sets
        powers = Powers()
        for batch in batches:
            rows = [(*digest(s), s.tobytes()) for s in shingle_sets(batch.column("text"), powers, width) if len(s)]
            d1, d2, sets = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sets, pa.binary())], ["d1", "d2", "set"])
    return found


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    packed = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)
    return np.concatenate([packed >> 4, packed & 15], axis=1)


def _alike(sig_a: np.ndarray, sig_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Rows that agree on enough tokens and whose sizes allow the similarity."""
    sizes = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * SIMILARITY
    return sizes & ((sig_a == sig_b).sum(axis=1) >= AGREE)


def _small_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidates inside nodes of at most SMALL members; rows come sorted by node."""
    left = None

    def pairs(node, rep, n, sig):
        a, b = [], []
        for d in range(1, SMALL):
            at = np.flatnonzero(node[d:] == node[:-d]) if len(node) > d else ()
            if not len(at):
                break
            at = at[_alike(sig[at], sig[at + d], n[at], n[at + d])]
            a.append(np.minimum(rep[at], rep[at + d]))
            b.append(np.maximum(rep[at], rep[at + d]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy() for c in ("node", "rep", "n")] + [_matrix(batch.column("brief"))]
        if left is not None:
            now = [np.concatenate(x) for x in zip(left, now, strict=True)]
        last = np.searchsorted(now[0], now[0][-1])        # the last node may go on in the next batch
        left = [x[last:] for x in now]
        yield pairs(*(x[:last] for x in now))
    if left is not None:
        yield pairs(*left)


def _alike_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = _alike(_matrix(batch.column("brief_a")), _matrix(batch.column("brief_b")),
                          batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def _children(rows: DataFrame) -> DataFrame:
    """node, tree, rep, up (the parent's size): every member once per position that its node picks."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS)).cast("int")
    position = [first]
    for k in range(1, BRANCHES):                          # different positions
        position.append(F.pmod(first + F.lit(k) + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS // BRANCHES - 1)).cast("int") * k, F.lit(TOKENS)))
    child = F.explode(F.array(*[F.xxhash64("node", p, F.substring("sig", 2 * p + 1, 2)) for p in position]))
    return rows.select(child.alias("child"), "tree", "rep", "up").withColumnRenamed("child", "node")


def _nodes(scratch: Scratch, reps: DataFrame, total: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, rep) of small nodes and (node, tree, rep, size) of dense ones, all with two members at least."""
    roots = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit("tree"), F.lit(t)).alias("node")) for t in range(TREES)]))
    rows = _children(reps.select("rep", "sig", roots.alias("r")).select("rep", "sig", "r.tree", "r.node", F.lit(total).cast("long").alias("up")))
    small, dense, depth = None, None, 1
    add = lambda x, y: y if x is None else x.unionByName(y)
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        live = scratch.keep(rows.join(sizes, "node"), f"live{depth}")
        # a node that holds nearly all of its parent is alike only if it isn't the parent of unrelated documents at the top
        is_dense = (F.col("size") > SMALL) & ((F.col("size") > ALIKE * F.col("up")) | F.lit(depth >= MAX_DEPTH))
        small = add(small, live.filter(F.col("size") <= SMALL).select("node", "rep"))
        dense = add(dense, live.filter(is_dense).select("node", "tree", "rep", "size"))
        open_ = live.filter((F.col("size") > SMALL) & ~is_dense)
        if depth >= MAX_DEPTH or open_.isEmpty():
            return small, dense
        rows = _children(open_.select("node", "tree", "rep", F.col("size").alias("up")).join(reps.select("rep", "sig"), "rep"))
        depth += 1


class Links:
    """Confirmed links and their components, both as tables."""

    def __init__(self, scratch: Scratch, docs: DataFrame, signed: DataFrame, reps: DataFrame, width: int):
        self.scratch, self.docs, self.signed, self.reps, self.width = scratch, docs, signed, reps, width
        self.component: DataFrame | None = None             # rep, comp (only reps with a link)

    def alike(self, pairs: DataFrame) -> DataFrame:
        r = self.reps
        return (pairs.join(r.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("brief").alias("brief_a")), "a")
                .join(r.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("brief").alias("brief_b")), "b")
                .select("a", "b", "n_a", "n_b", "brief_a", "brief_b").mapInArrow(_alike_rows, "a long, b long"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """rep and its full shingle set, from the texts of the reps in `wanted`."""
        wanted = self.scratch.keep(wanted.select("rep").distinct().join(
            self.signed.select(F.col("rid").alias("rep"), F.col("doc_id").alias("id"), "d1", "d2"), "rep"), "wanted")
        ids = wanted.select("id").distinct()
        if ids.count() <= MAX_BROADCAST_IDS:
            ids = F.broadcast(ids)
        texts = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")
        sets = (texts.mapInArrow(_sets(self.width), "d1 long, d2 long, set binary").join(wanted.select("rep", "d1", "d2"), ["d1", "d2"])
                .select("rep", "set").dropDuplicates(["rep"]))
        sets = self.scratch.keep(sets, "sets")
        self.scratch.drop(wanted)
        return sets

    def add(self, linked: DataFrame) -> None:
        linked = self.scratch.keep(linked, "links")
        self.component = components(self.scratch, linked if self.component is None else _stars(self.component).unionByName(linked))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """rep, comp (the smallest rep of its component), by alternating large-star and small-star rounds.

    It ends when the graph is a set of stars: every end hangs on one smallest rep that hangs on none.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    while True:
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        before, now = now, scratch.keep(small, "stars")
        scratch.drop(before)
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("top")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("top")))
        if ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("top").alias("top")).filter("child + top > 1").isEmpty():
            break
    tops = now.select(F.col("v").alias("rep")).distinct().select("rep", F.col("rep").alias("comp"))
    return scratch.keep(now.select(F.col("u").alias("rep"), F.col("v").alias("comp")).unionByName(tops), "components")


def _stars(component: DataFrame) -> DataFrame:
    """Components as links to their smallest reps, to go on from when links are added."""
    return component.filter("rep <> comp").select(F.col("comp").alias("a"), F.col("rep").alias("b"))


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _named(rows: DataFrame, component: DataFrame | None) -> DataFrame:
    """rows with comp; a rep that no pair connects is its own component."""
    if component is None:
        return rows.withColumn("comp", F.col("rep"))
    return rows.join(component, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _stragglers(scratch: Scratch, groups: DataFrame, component: DataFrame | None) -> DataFrame:
    """Members (node, rep) of groups that hold more than one component, with comp, and main: the group's largest one."""
    named = scratch.keep(_named(groups.select("node", "rep"), component), "named")
    per = named.groupBy("node", "comp").agg(F.count("*").alias("n"))
    mixed = (per.groupBy("node").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
             .filter("comps > 1").select("node", F.col("top.comp").alias("main")))
    return named.join(mixed, "node")


class _Block:
    """Full sets of a block's members, with an inverted index."""

    def __init__(self, rows: pd.DataFrame):
        self.sets = [np.frombuffer(v, dtype=np.uint64) for v in rows["set"]]
        self.n, self.rep = np.array([len(x) for x in self.sets]), rows["rep"].to_numpy()
        every = np.concatenate(self.sets)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], np.repeat(np.arange(len(self.sets)), self.n)[order]

    def linked(self, x: np.ndarray) -> np.ndarray:
        """Which members are similar enough to the set x."""
        low, high = np.searchsorted(self.every, x, "left"), np.searchsorted(self.every, x, "right")
        size = high - low
        at = np.repeat(high - np.cumsum(size), size) + np.arange(size.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sets))
        return 100 * both >= SIMILARITY * (len(x) + self.n - both)


def _pairs_frame(out: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})


def _block_links(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components of a block: every member against all, one link per component met."""
    out, block, top = [], _Block(rows), np.arange(len(rows))
    for i, x in enumerate(block.sets):
        if (top == top[0]).all():
            break
        near = np.flatnonzero(block.linked(x) & (top != top[i]))
        first = near[np.unique(top[near], return_index=True)[1]]
        if len(first):
            out.append(pd.DataFrame({"a": np.minimum(block.rep[i], block.rep[first]), "b": np.maximum(block.rep[i], block.rep[first])}))
            top[np.isin(top, top[first])] = top[i]
    return _pairs_frame(out)


def _family(compare):
    """For each straggler the members that `compare` finds, as pairs that join two components: one for every component that a block's earlier pairs have not joined to its own."""
    def links(key, asks: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(members):
            rep, n = members["rep"].to_numpy(), len(members)
            top = np.unique(np.concatenate([members["comp"], asks["comp"]]), return_inverse=True)[1]       # components, as joined so far
            for i, (r, hits) in enumerate(zip(asks["rep"], compare(asks, members), strict=True), n):
                near = np.flatnonzero((top[:n] != top[i]) & hits)
                if len(near):
                    first = near[np.unique(top[near], return_index=True)[1]]
                    out.append(pd.DataFrame({"a": np.minimum(r, rep[first]), "b": np.maximum(r, rep[first])}))
                    top[np.isin(top, top[first])] = top[i]
        return _pairs_frame(out)
    return links


def _by_set(asks: pd.DataFrame, members: pd.DataFrame) -> Iterator[np.ndarray]:
    block = _Block(members)
    return (block.linked(np.frombuffer(v, dtype=np.uint64)) for v in asks["set"])


def _by_tokens(asks: pd.DataFrame, members: pd.DataFrame) -> Iterator[np.ndarray]:
    matrix, n = _matrix(members["brief"]), members["n"].to_numpy()
    return (_alike(matrix, x, n, m) for x, m in zip(_matrix(asks["brief"]), asks["n"], strict=True))


def _blocks(clusters: DataFrame) -> DataFrame:
    """cluster, nb, rep and block of every member; pivots stand in all blocks of their cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size")).select("cluster", F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"))
    rows = clusters.join(sizes, "cluster").withColumn("h", F.xxhash64("rep", F.lit(3)))
    rows = rows.withColumn("block", F.pmod("h", F.col("nb")).cast("int"))
    # pivots: the smallest hashes of a cluster, found as the smallest of its first blocks' members
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("h", "rep"))
    pivots = (rows.filter("nb > 1").withColumn("r", rank).filter(F.col("r") <= BLOCK_PIVOTS)
              .select("cluster", "nb", "rep", "h", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("block")))
    return rows.select("cluster", "nb", "rep", "block").unionByName(pivots.select("cluster", "nb", "rep", "block")).distinct()


def _families(scratch: Scratch, mixed: DataFrame, payload: DataFrame, compare) -> DataFrame:
    """Pairs of stragglers and members of their families (named by main component), in each block too few for a cycle; payload: rep and what `compare` reads."""
    family = scratch.keep(mixed.select(F.col("main").alias("family"), "rep", "comp").distinct(), "families")
    per = (family.groupBy("family").agg(F.count("*").alias("n"), F.sum((F.col("comp") != F.col("family")).cast("long")).alias("m"))
           .select("family", F.ceil(F.col("n") / BLOCK).cast("int").alias("mb_n"), F.ceil(F.col("m") / BLOCK).cast("int").alias("sb_n")))
    rows = family.join(per, "family").join(payload, "rep")
    cols = ["family", "sb", "mb", "rep", "comp", *[c for c in payload.columns if c != "rep"]]
    own = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = rows.filter("comp <> family").withColumn("sb", own("sb_n", 1)).withColumn("mb", every("mb_n")).select(*cols)
    members = rows.withColumn("mb", own("mb_n", 2)).withColumn("sb", every("sb_n")).select(*[F.col(c).alias(c) for c in cols])
    keys = ["family", "sb", "mb"]
    return asks.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(_family(compare), "a long, b long").distinct()


def _decided(scratch: Scratch, docs: DataFrame, width: int) -> DataFrame:
    """doc_id, rid, n, component_id, comp of every row of `docs`, and file, file2, at where it has them; comp is null for rows without shingles."""
    passed = [c for c in ("doc_id", "file", "file2", "at") if c in docs.columns]
    docs = docs.select(*passed, "text")
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in passed)
    signed = scratch.keep(docs.mapInArrow(_signed(width, passed), f"{kinds}, n long, d1 long, d2 long, sig binary, brief binary")
                          .withColumn("rid", F.monotonically_increasing_id()), "signed")
    groups = scratch.keep(signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least")), "groups")
    reps = scratch.keep(signed.join(groups.select(F.col("rep").alias("rid")), "rid").select(F.col("rid").alias("rep"), "n", "sig", "brief"), "reps")
    links = Links(scratch, docs, signed, reps, width)
    small, dense = _nodes(scratch, reps, reps.count())
    rows = small.join(reps.drop("sig"), "rep").select("node", "rep", "n", "brief").repartition("node").sortWithinPartitions("node")
    pairs = rows.mapInArrow(_small_pairs, "a long, b long")
    has_dense = not dense.isEmpty()
    if has_dense:
        # pivots of a node: the members with the smallest hashes; a member meets those of its largest node
        least = [F.min(F.struct(F.xxhash64("node", "rep", F.lit(i)), "rep")).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = dense.groupBy("node").agg(*least).select("node", F.explode(F.array(*[F.col(f"p{i}.rep") for i in range(PIVOTS)])).alias("pivot"))
        mine = dense.groupBy("rep").agg(F.max(F.struct("size", "node")).alias("x")).select("rep", "x.node")
        stars = mine.join(pivots, "node").filter("rep <> pivot").select(*_ordered("rep", "pivot"))
        pairs = pairs.unionByName(links.alike(stars.distinct()))
    pairs = scratch.keep(pairs.distinct(), "candidates")
    clusters = components(scratch, pairs)
    if has_dense:
        mixed = _stragglers(scratch, dense, clusters)
        more = scratch.keep(_families(scratch, mixed, reps.drop("sig"), _by_tokens), "more")
        if not more.isEmpty():
            clusters = components(scratch, _stars(clusters).unionByName(more))
    blocks = scratch.keep(_blocks(clusters.withColumnRenamed("comp", "cluster")), "blocks")
    sets = links.sets(blocks)
    links.add(blocks.join(sets, "rep").groupBy("cluster", "block").applyInPandas(_block_links, "a long, b long"))
    # what the blocks of one cluster keep apart
    large = scratch.keep(blocks.filter("nb > 1").select(F.col("cluster").alias("node"), "rep").distinct(), "large")
    if not large.isEmpty():
        apart = _stragglers(scratch, large, links.component)
        more = scratch.keep(_families(scratch, apart, sets, _by_set), "more")
        if not more.isEmpty():
            links.add(more)
    named = _named(groups.select("d1", "d2", "rep", "least"), links.component)
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = named.join(smallest, "comp").select("d1", "d2", "comp", "component_id", F.lit(True).alias("in_set"))
    alone = F.col("in_set").isNull()
    return (signed.join(known, ["d1", "d2"], "left")
            .withColumn("in_set", F.when(F.col("n") > 0, F.col("in_set")))
            .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
            .select(*passed, "rid", "n", "component_id", F.when(~alone, F.col("comp")).alias("comp")))


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs`, over shingles of `width` words."""
    return (_decided(Scratch(docs.sparkSession), docs.select("doc_id", "text"), width)
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def kept_rows(docs: DataFrame, width: int = 2) -> DataFrame:
    """One row of each component (smallest doc_id, then row number) and every row without shingles, all columns.

    Only the places of rows that go are kept and joined.
    """
    scratch = Scratch(docs.sparkSession)
    rows = located(scratch, docs, "doc_id", "text")
    decided = _decided(scratch, rows.select("doc_id", "text", "place.file", "place.file2", "place.at"), width)
    decided = scratch.keep(decided.filter("comp IS NOT NULL").select("doc_id", "rid", "comp", F.struct("file", "file2", "at").alias("place")), "decided")
    first = decided.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first")).select("first.rid")
    gone = scratch.keep(decided.join(first, "rid", "left_anti").select("place"), "gone")
    scratch.only(gone, *scratch.stored(rows))
    return rows.select("row", "place").join(gone, "place", "left_anti").select("row.*")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM words WHERE len(w) > 1
  UNION ALL SELECT doc_id, w[1] FROM words WHERE len(w) = 1),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM common JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y WHERE 100 * n_common >= 80 * (sx.n + sy.n - n_common)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
"""
