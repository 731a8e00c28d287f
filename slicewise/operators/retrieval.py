"""Retrieval: nearest-neighbour join (J2), top-k (T1, T2), metadata filter (P15),
returned columns (P17), approximate search (T3), and the built-in lexical
embedder used when no model vectors are supplied (X7).

Plan: the query side (at most a few questions per experiment, materialised by
the callers) is joined on the collection, so each chunk meets only the questions of its own
collection; Spark broadcasts it while its size is below
`spark.sql.autoBroadcastJoinThreshold` and splits skewed collections otherwise. Both sides are joined
as blocks of rows, which are scored by matrix products (`block_search`).
`row_number() <= max_k` over (query) becomes a WindowGroupLimit that
keeps max_k rows per query per partition before the shuffle, so skewed
collections send only max_k candidates each, also when k is a column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.functions.text import tokens
from slicewise.operators.block_search import nearest

# Dimensions of the built-in lexical embedding; name written to output metadata.
LEXICAL_DIMS = 64
LEXICAL_EMBEDDER = "hashed-tf-md5-64"


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two float/double arrays of any length (higher-order functions)."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def squared_l2_fixed(a: str, b: str, dims: int) -> Column:
    """The same distance for a known dimension, unrolled into element arithmetic.

    Plain `a[i]` accesses and arithmetic compile into whole-stage codegen, where
    the higher-order form is interpreted per element. Summation order is the
    same left-to-right order, so both forms give identical doubles.
    """
    terms = " + ".join(f"(CAST(`{a}`[{i}] AS DOUBLE) - CAST(`{b}`[{i}] AS DOUBLE)) * "
                       f"(CAST(`{a}`[{i}] AS DOUBLE) - CAST(`{b}`[{i}] AS DOUBLE))" for i in range(dims))
    return F.expr(f"0.0D + {terms}")


def unscorable(vectors: DataFrame, vector_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """D-17: rows that take no part in a search, with the reason."""
    v = F.col(vector_col)
    reason = (F.when(v.isNull(), "no vector").when(F.exists(v, lambda x: x.isNull()), "vector with a missing component")
              .when(F.size(v) != F.lit(dims if dims is not None else -1), "vector of another length" if dims is not None else None))
    return vectors.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def knn(queries: DataFrame, vectors: DataFrame, k: int | str | None, query_key: str = "query_id",
        join_keys: tuple[str, ...] = ("collection",), where: dict | None = None,
        where_query: dict[str, str] | None = None, vector_col: str = "embedding", query_vector_col: str = "query_vector",
        order_tiebreak: str = "chunk_index", include: tuple[str, ...] = (), dims: int | None = None,
        max_k: int | None = None) -> DataFrame:
    """Exact top-k nearest chunks per query (ascending squared L2, ties by chunk_index).

    queries: query_key, join_keys..., query_vector[, k column]
    vectors: join_keys..., chunk_id, chunk_index, embedding, metadata...
    where (P15): {metadata column: value} equality filter applied before scoring;
    where_query: {metadata column: query column} per-query equality filter.
    k is a number or the name of a query column (then max_k bounds it, by default the
    largest k of the queries); k larger than the collection, or None, returns the whole collection (T2).
    include (P17): extra vector-side columns to return.
    dims: vector length, for the unrolled, codegen'd distance; None uses the generic form.
    Vectors that are null, hold a null or have another length than the query's (or dims)
    have no distance and take no part; `unscorable` lists them.
    """
    v = vectors
    for col, value in (where or {}).items():
        v = v.filter(F.col(col) == F.lit(value))
    # rename the query side so a query set derived from the vectors joins unambiguously
    q = queries.select(*[F.col(c).alias("_q_" + c) for c in queries.columns])
    cond = [F.col(c) == F.col("_q_" + c) for c in join_keys]
    for col, qcol in (where_query or {}).items():
        cond.append(F.col(col) == F.col("_q_" + qcol))
    if not cond:
        raise ValueError("knn needs a join key (collection) or a per-query filter: all-pairs scoring is not offered")
    lengths = F.size(vector_col), F.size("_q_" + query_vector_col)
    if dims is None:
        cond.append(lengths[0] == lengths[1])
    else:
        v, q = v.filter(lengths[0] == dims), q.filter(lengths[1] == dims)
    keep = [F.col("_q_" + query_key).alias(query_key)] + [F.col(c) for c in join_keys] + \
        [F.col("chunk_id"), F.col(order_tiebreak)] + [F.col(c) for c in include]
    w = Window.partitionBy(query_key).orderBy("distance", order_tiebreak)
    if k is None:
        dist = (squared_l2_fixed(vector_col, "_q_" + query_vector_col, dims) if dims
                else squared_l2(F.col(vector_col), F.col("_q_" + query_vector_col)))
        scored = v.join(q, cond).select(*keep, dist.alias("distance")).filter(F.col("distance").isNotNull())
        return scored.withColumn("rank", F.row_number().over(w))
    if max_k is None:
        max_k = (queries.agg(F.max(k)).first()[0] or 0) if isinstance(k, str) else k
    on = [(c, "_q_" + c) for c in join_keys] + [(c, "_q_" + qcol) for c, qcol in (where_query or {}).items()]
    wanted = F.col("_q_" + k) if isinstance(k, str) else F.lit(k)
    asked = q.select("_q_" + query_key, *{b: None for _, b in on}, "_q_" + query_vector_col,
                     F.when(wanted > max_k, F.lit(int(max_k))).otherwise(wanted).cast("long").alias("_k"))
    rows = v.select(*{c: None for c in (*(a for a, _ in on), "chunk_id", order_tiebreak, *include, vector_col)})
    scored = nearest(rows, asked, on, "_k", [order_tiebreak], vector_col, "_q_" + query_vector_col).select(*keep, "distance", "_k")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("rank") <= F.lit(int(max_k))) & (F.col("rank") <= F.col("_k"))).drop("_k")


def centroids(vectors: DataFrame, group_col: str, vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """Mean vector per group (rounded), as query vectors derived from a collection."""
    exploded = vectors.select(group_col, F.posexplode(vector_col).alias("pos", "x"))
    means = exploded.groupBy(group_col, "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("m"))
    return means.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("query_vector"))


# --------------------------------------------------------------------------- lexical embedder (X7 default)
def token_buckets(text: Column, dims: int = LEXICAL_DIMS) -> Column:
    """Bucket of every token: first 32 bits of md5(token) modulo dims (reproducible in SQL).

    For dims dividing 256 only the 4th byte of those 32 bits matters (256 = 0 mod dims),
    so just its two hex digits are parsed.
    """
    if 256 % dims == 0:
        return F.transform(tokens(text),
                           lambda t: F.pmod(F.conv(F.substring(F.md5(t), 7, 2), 16, 10).cast("long"), F.lit(dims)))
    return F.transform(tokens(text),
                       lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dims)))


def with_lexical_embedding(df: DataFrame, text_col: str, out_col: str = "embedding",
                           dims: int = LEXICAL_DIMS) -> DataFrame:
    """Hashed term-frequency vector, L2-normalised, computed map-side in O(n log n + dims).

    Bucket ids are sorted, run starts give per-bucket counts, a map turns the
    sparse counts into a dense vector. Each step reads materialised columns,
    so no lambda re-evaluates an outer array.
    """
    staged = df.withColumn("_b", F.array_sort(token_buckets(F.col(text_col), dims)))
    n = F.size("_b")
    staged = staged.withColumn(
        "_st", F.when(n > 0, F.filter(F.sequence(F.lit(1), n),
                                      lambda i: (i == 1) | (F.element_at("_b", i) != F.element_at("_b", F.greatest(i - 1, F.lit(1))))))
        .otherwise(F.array().cast("array<int>")))
    ends = F.when(F.size("_st") > 0, F.concat(F.slice("_st", 2, F.greatest(F.size("_st") - 1, F.lit(0))),
                                              F.array(n + 1))).otherwise(F.array().cast("array<int>"))
    staged = staged.withColumn(
        "_m", F.map_from_arrays(F.transform("_st", lambda i: F.element_at("_b", i)),
                                F.zip_with("_st", ends, lambda a, b: (b - a).cast("double"))))
    # `_m` is referenced twice so Catalyst keeps it materialised instead of
    # inlining the map construction into the per-dimension lambda. (Unrolling
    # these 64-wide steps into element arithmetic measured 2.5x slower: the
    # generated methods grow past the JIT's size limit.)
    staged = staged.withColumn(
        "_v", F.when(F.size("_m") >= 0, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                                   lambda d: F.coalesce(F.element_at("_m", d.cast("long")), F.lit(0.0)))))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    return (staged.withColumn("_n", norm)
                  .withColumn(out_col, F.when(F.col("_n") > 0, F.transform("_v", lambda x: x / F.col("_n")))
                              .otherwise(F.col("_v")))
                  .drop("_b", "_st", "_m", "_v", "_n"))


# --------------------------------------------------------------------------- approximate
# The numbers that make up the projection planes, so that SQL computes the same ones.
PLANE_SQL = "(({i} * {i} * 31 + {i} * ({t} * 97 + 13) + {t} * 7919) % 1009) / 504.5 - 1"


def plane(t: int, dims: int) -> list[float]:
    """Projection t: components in [-1, 1) by a fixed rule."""
    return [((i * i * 31 + i * (t * 97 + 13) + t * 7919) % 1009) / 504.5 - 1 for i in range(dims)]


def _buckets(vector_col: str, dims: int, num_tables: int, bucket_length: float) -> Column:
    """array<struct<t, bucket>>: one bucket per projection, unrolled for whole-stage codegen."""
    parts = []
    for t in range(num_tables):
        dot = " + ".join(f"CAST(`{vector_col}`[{i}] AS DOUBLE) * CAST({w!r} AS DOUBLE)" for i, w in enumerate(plane(t, dims)))
        parts.append(f"named_struct('t', {t}, 'bucket', CAST(floor((0.0D + {dot}) / {bucket_length}D) AS BIGINT))")
    return F.expr(f"array({', '.join(parts)})")


def knn_lsh(queries: DataFrame, vectors: DataFrame, k: int, dims: int, bucket_length: float = 0.5, num_tables: int = 4,
            probes: int = 1, query_key: str = "query_id", join_keys: tuple[str, ...] = ("collection",)) -> DataFrame:
    """Approximate top-k: exact distances to the vectors that share a bucket of some random projection.

    A vector has one bucket per table; a query looks into its own and `probes` neighbours on
    either side. Collection, table and bucket are the join key of the blocks that are scored; a pair
    that shares several buckets is scored in the first table that brings it together. Fewer than k
    candidates give fewer rows; `probes` and `num_tables` trade work for recall.

    Output: query_key, join_keys, chunk_id, chunk_index, distance (squared), rank.
    """
    keys = list(join_keys)
    ok = lambda c: (F.size(c) == dims) & F.forall(c, lambda x: x.isNotNull())
    v = vectors.filter(ok("embedding") & F.col("chunk_id").isNotNull())
    q = queries.filter(ok("query_vector") & F.col(query_key).isNotNull())
    hashed = lambda df, c: df.withColumn("_h", _buckets(c, dims, num_tables, bucket_length)).withColumn("_b", F.explode("_h"))
    stored = hashed(v, "embedding").select(*keys, "chunk_id", "chunk_index", "embedding", F.col("_b.t").alias("_t"),
                                           F.col("_b.bucket").alias("_bucket"), F.col("_h.bucket").alias("_h"))
    near = F.explode(F.sequence(F.col("_b.bucket") - probes, F.col("_b.bucket") + probes))
    asked = hashed(q, "query_vector").select(*[F.col(c).alias("_q_" + c) for c in keys], F.col(query_key).alias("_q_" + query_key), "query_vector",
                                             F.col("_b.t").alias("_q_t"), near.alias("_q_bucket"), F.col("_h.bucket").alias("_q_h"),
                                             F.lit(k).cast("long").alias("_k"))
    on = [*((c, "_q_" + c) for c in keys), ("_t", "_q_t"), ("_bucket", "_q_bucket")]
    scored = (nearest(stored, asked, on, "_k", ["chunk_index"], rule=_first_shared(num_tables, probes))
              .select(F.col("_q_" + query_key).alias(query_key), *keys, "chunk_id", "chunk_index", "distance"))
    w = Window.partitionBy(query_key).orderBy("distance", "chunk_index")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _first_shared(num_tables: int, probes: int):
    """Pairs that no earlier table has brought together, so a pair is scored once however many buckets it shares."""
    def rule(v_rows, q_rows):
        table = v_rows.field("_t")[0].as_py()
        mine = v_rows.field("_h").flatten().to_numpy().reshape(-1, num_tables)
        asked = q_rows.field("_q_h").flatten().to_numpy().reshape(-1, num_tables)

        def counts(a: int, b: int):
            new = np.ones((b - a, len(mine)), dtype=bool)
            for t in range(table):
                new &= np.abs(asked[a:b, None, t] - mine[None, :, t]) > probes
            return new
        return counts
    return rule
