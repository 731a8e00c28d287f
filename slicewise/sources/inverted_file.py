"""A stored inverted file of chunk vectors (T3, and T1 with data skipping).

`build` learns a quantiser, sends every vector to the cell of its nearest centroid and stores
Parquet tables below one path (`calibrate` adds one, with the probes that a recall takes):

* `quantiser` (cell, centroid): at most MAX_QUANTISER_BYTES, whatever the corpus;
* `cells` (collection, cell, n, radius): how many vectors of a collection a cell got, and the largest
  distance to its centroid; several rows of one cell add up, so `append` only writes;
* `vectors`: the rows, partitioned by cell and sorted by collection and distance to the centroid, so a probe
  prunes folders by cell (dynamic partition pruning) and row groups by collection and distance.

`search` probes cells in order of their centroids' distances until k rows and `probes` cells are reached;
`calibrate` measures on stored vectors how many cells a wanted recall takes and stores the number.
With `exact` it goes on: the kth distance t found so far rules out every cell whose nearest
possible vector is farther (triangle inequality on the radius), and within the others every vector whose
stored distance to the centroid differs from the question's by more than t. What remains is scored, so the answer is
that of a scan. Vectors that are null, hold a null or non-finite component or have another length take no part.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slicewise.operators.block_search import nearest
from slicewise.session import checkpoint_dir, cut_lineage

MAX_QUANTISER_BYTES = 64 << 20        # centroids go to every task
TRAIN_ROWS_PER_CELL = 64              # the quantiser is learnt from so many rows per cell, drawn by hash
EVERY = 1 << 31                       # more rows than a block holds
ROWS_PER_FILE = 1 << 20               # a cell with more rows is written by several tasks
CALIBRATION_ROWS = 256                # stored vectors, drawn by hash, that `calibrate` asks for
MIN_RECALL = 0.95                     # what `calibrate` aims at
SLACK = 1e-9                          # relative and absolute allowance for rounding in the bounds


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector can be scored."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dims) & finite


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row of x, and the distance to it (taken from differences, free of cancellation)."""
    cell = np.argmin((centroids * centroids).sum(axis=1)[None, :] - 2.0 * (x @ centroids.T), axis=1)
    return cell, np.sqrt(((x - centroids[cell]) ** 2).sum(axis=1))


def _with_cell(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The columns `cell` and `to_centroid` of every vector."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("to_centroid", T.DoubleType())])

    @F.pandas_udf(schema)
    def nearest(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "to_centroid": pd.Series([], dtype="float64")})
        cell, dist = _nearest(_matrix(v), centroids)
        return pd.DataFrame({"cell": cell.astype("int32"), "to_centroid": dist})

    return (df.withColumn("_nearest", nearest("embedding"))
            .select(*df.columns, F.col("_nearest.cell").alias("cell"), F.col("_nearest.to_centroid").alias("to_centroid")))


def learn_quantiser(vectors: DataFrame, dims: int, cells: int, rounds: int = 6) -> np.ndarray:
    """Centroids by Lloyd's rounds over a sample of TRAIN_ROWS_PER_CELL * cells rows, drawn by a hash of the row's vector.

    A round is one Spark job: tasks send one sum per cell, the driver sees cells x dims numbers. A cell that no
    row chooses keeps its centroid.
    """
    if cells * dims * 8 > MAX_QUANTISER_BYTES:
        raise ValueError(f"{cells} cells of {dims} dimensions exceed the quantiser's {MAX_QUANTISER_BYTES} bytes")
    # copies of one vector are drawn once: they would fill the start with equal centroids
    sample = (vectors.select("embedding", F.xxhash64("embedding").alias("h")).dropDuplicates(["h"])
              .orderBy("h").limit(cells * TRAIN_ROWS_PER_CELL))
    sample = cut_lineage(sample.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "h"))
    start = sample.orderBy("h").limit(cells).toPandas()["embedding"]
    centroids = _matrix(start)
    for _ in range(rounds if len(centroids) else 0):
        assigned = _with_cell(sample, centroids)
        sums = (assigned.groupBy("cell").agg(F.count("*").alias("n"), *[F.sum(F.col("embedding")[i].cast("double")).alias(f"s{i}")
                                                                        for i in range(dims)]).toPandas())
        moved = centroids.copy()
        moved[sums["cell"].to_numpy()] = sums[[f"s{i}" for i in range(dims)]].to_numpy() / sums[["n"]].to_numpy()
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def build(vectors: DataFrame, path: str, dims: int, cells: int | None = None) -> None:
    """Store `vectors` (collection, chunk_id, chunk_index, embedding, further columns) as an inverted file.

    cells: by default the square root of the number of vectors, as far as the quantiser's bytes allow.
    Columns named cell or to_centroid are not accepted. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    clash = {"cell", "to_centroid", "_salt", "_nearest"} & set(vectors.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are the index's own")
    rows = vectors.filter(usable(F.col("embedding"), dims))
    if cells is None:
        cells = min(max(1, math.isqrt(rows.count())), MAX_QUANTISER_BYTES // (dims * 8))
    centroids = learn_quantiser(rows, dims, cells)
    stored = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)],
                                   "cell int, centroid array<double>")
    stored.coalesce(1).write.parquet(f"{path}/quantiser")
    append(vectors, path, dims)


def quantiser(spark: SparkSession, path: str) -> np.ndarray:
    """The stored centroids, row = cell (bounded by MAX_QUANTISER_BYTES)."""
    return _matrix(spark.read.parquet(f"{path}/quantiser").orderBy("cell").toPandas()["centroid"])


def append(vectors: DataFrame, path: str, dims: int) -> None:
    """Add rows to a stored index; no stored file is read or rewritten.

    The cells' figures are written before the rows: an append that dies in between leaves figures that are too
    wide, which costs probes but loses nothing.
    """
    spark = vectors.sparkSession
    centroids = quantiser(spark, path)
    rows = vectors.filter(usable(F.col("embedding"), dims))
    if not len(centroids):
        if rows.limit(1).count():
            raise ValueError("the index was built from an empty table and has no cells; build it anew")
        placed = rows.withColumn("cell", F.lit(0)).withColumn("to_centroid", F.lit(0.0)).limit(0)
    else:
        placed = cut_lineage(_with_cell(rows, centroids))
    per_cell = placed.groupBy("collection", "cell").agg(F.count("*").alias("n"), F.max("to_centroid").alias("radius"))
    per_cell.coalesce(1).write.mode("append").parquet(f"{path}/cells")
    sizes = per_cell.groupBy("cell").agg(F.ceil(F.sum("n") / ROWS_PER_FILE).cast("int").alias("_files"))
    salted = (placed.join(sizes, "cell").withColumn("_salt", F.pmod(F.xxhash64("chunk_id", "chunk_index"), F.col("_files")))
              .repartition("cell", "_salt").drop("_files", "_salt"))
    (salted.sortWithinPartitions("cell", "collection", "to_centroid")
     .write.mode("append").partitionBy("cell").parquet(f"{path}/vectors"))


def scratch_path(spark: SparkSession) -> str:
    """A new place for an index in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/slicewise-tables/{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/vectors").parquet(f"{path}/vectors")


def _probes(spark: SparkSession, path: str, queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(question, cell of its collection): distance to the centroid, the cell's rows and radius, place in probing order."""
    @F.pandas_udf("array<double>")
    def distances(v: pd.Series) -> pd.Series:
        # one question at a time: cells x dims numbers of working memory
        return pd.Series([np.sqrt(((centroids - np.asarray(x, dtype=np.float64)) ** 2).sum(axis=1)) for x in v], dtype=object)

    cells = (spark.read.parquet(f"{path}/cells").groupBy("collection", "cell")
             .agg(F.sum("n").alias("n"), F.max("radius").alias("radius")))
    far = queries.withColumn("_d", distances("query_vector"))
    asked = (far.join(cells, "collection")
             .select("query_id", "collection", "query_vector", "cell", "n", "radius", F.col("_d")[F.col("cell")].alias("to_query")))
    w = Window.partitionBy("query_id", "collection").orderBy("to_query", "cell")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return asked.withColumn("place", F.row_number().over(w)).withColumn("rows_before", before)


def _scored(probes: DataFrame, vectors: DataFrame, dims: int, k: int | None = None, within: bool = False) -> DataFrame:
    """Vectors of the probed cells with their distance to the question (squared, as everywhere); with k, the k nearest of each block.

    within: only vectors whose distance to the centroid lies between the probe's `low` and `high`.
    """
    # a cell's questions together, so that they meet its vectors as blocks
    p = (probes.select(*[F.col(c).alias("_p_" + c) for c in ("query_id", "collection", "cell", "query_vector", *(("low", "high") if within else ()))])
         .repartition("_p_collection", "_p_cell").withColumn("_k", F.lit(k if k else EVERY).cast("long")))
    # only the folders of probed cells are read
    v = vectors.filter(F.size("embedding") == dims).join(probes.select("collection", "cell").distinct(), ["collection", "cell"], "left_semi").select("collection", "cell", "chunk_id", "chunk_index", "to_centroid", "embedding")
    hits = nearest(v, p, [("collection", "_p_collection"), ("cell", "_p_cell")], "_k", ["chunk_index", "chunk_id"],
                   query_vector_col="_p_query_vector", rule=_within if within else None)
    return hits.select(F.col("_p_query_id").alias("query_id"), "collection", "chunk_id", "chunk_index", "cell", "distance")


def _within(v_rows, q_rows):
    to_centroid, low, high = (x.to_numpy(zero_copy_only=False) for x in (v_rows.field("to_centroid"), q_rows.field("_p_low"), q_rows.field("_p_high")))
    return lambda a, b: (to_centroid[None, :] >= low[a:b, None]) & (to_centroid[None, :] <= high[a:b, None])


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "collection").orderBy("distance", "chunk_index", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def calibrate(spark: SparkSession, path: str, k: int, dims: int, recall: float = MIN_RECALL) -> int:
    """Find and store the number of cells to probe so that `recall` of the k nearest rows is expected.

    CALIBRATION_ROWS stored vectors are searched exactly, themselves left out; the answer is the quantile `recall`
    of the places, in a question's probing order, of the cells that hold its true neighbours.
    """
    stored = _vectors(spark, path)
    drawn = (stored.select("collection", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
             .orderBy(F.xxhash64("collection", "query_id"), "query_id").limit(CALIBRATION_ROWS))
    asked = cut_lineage(drawn)
    hits = _search_exact(spark, path, asked, k + 1, dims, 1).filter(F.col("chunk_id") != F.col("query_id"))
    plan = _probes(spark, path, asked, quantiser(spark, path)).select("query_id", "collection", "cell", "place")
    place = hits.join(plan, ["query_id", "collection", "cell"]).agg(F.percentile("place", F.lit(recall))).first()[0]
    probes = max(1, math.ceil(place or 1))
    (spark.createDataFrame([(k, recall, probes)], "k int, recall double, probes int")
     .coalesce(1).write.mode("overwrite").parquet(f"{path}/probes"))
    return probes


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, dims: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """The k nearest stored vectors of every question (query_id, collection, query_vector) within its collection.

    Approximate: cells in order of centroid distance, at least `probes` of them (by default as many as `calibrate`
    stored) and on until they hold k rows, so k rows come back whenever the collection has them.
    exact: the same rows as a full scan (see the module's text).
    Questions with an unusable vector, or to a collection that is not stored, have no rows.
    Output: query_id, collection, chunk_id, chunk_index, distance (squared), rank; ties by chunk_index.
    """
    centroids = quantiser(spark, path)
    asked = queries.select("query_id", "collection", "query_vector").filter(usable(F.col("query_vector"), dims))
    if not len(centroids):
        empty = asked.select("query_id", "collection", F.lit(None).cast("long").alias("chunk_id"), F.lit(None).cast("long").alias("chunk_index"),
                             F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank"))
        return empty.limit(0)
    if exact:
        return _search_exact(spark, path, asked, k, dims, probes or 1).drop("cell")
    if probes is None:
        probes = spark.read.parquet(f"{path}/probes").first()["probes"]
    plan = _probes(spark, path, asked, centroids)
    return _top(_scored(plan.filter(_near(probes, k)), _vectors(spark, path), dims, k), k).drop("cell")


def _near(probes: int, k: int) -> Column:
    return (F.col("place") <= probes) | (F.col("rows_before") < k)


def _search_exact(spark: SparkSession, path: str, asked: DataFrame, k: int, dims: int, probes: int) -> DataFrame:
    vectors = _vectors(spark, path)
    plan = cut_lineage(_probes(spark, path, asked, quantiser(spark, path)))
    first = cut_lineage(_top(_scored(plan.filter(_near(probes, k)), vectors, dims, k), k))
    reach = remaining_probes(plan, first, _near(probes, k), k)
    return _top(first.drop("rank").unionByName(_scored(reach, vectors, dims, k, within=True)), k)


def remaining_probes(plan: DataFrame, first: DataFrame, near: Column, k: int) -> DataFrame:
    """Cells not yet probed that may hold a row nearer than the kth found, with the distances to the centroid such rows can have."""
    kth = (first.groupBy("query_id", "collection").agg(F.count("*").alias("_found"), F.sqrt(F.max("distance")).alias("_t"))
           .select("query_id", "collection", F.when(F.col("_found") >= k, F.col("_t")).alias("_t")))
    open_cells = plan.filter(~near).join(kth, ["query_id", "collection"], "left")
    # without k rows nothing is ruled out
    reach = F.coalesce(F.col("_t"), F.lit(float("inf"))) * (1 + SLACK) + SLACK
    allowance = F.col("to_query") * SLACK
    return (open_cells.withColumn("low", F.col("to_query") - reach - allowance).withColumn("high", F.col("to_query") + reach + allowance)
            .filter(F.col("low") <= F.col("radius")).drop("_t"))
