"""The chunk-vector index as a Parquet table partitioned by collection.

A collection is a partition: per-collection reads prune to one folder, a
rebuild overwrites only its own partitions (dynamic partition overwrite), and
counts per collection are an aggregate over partition values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_COLUMNS = ["collection", "chunk_id", "doc_id", "chunk_index", "chunk_text", "embedding", "version"]


def upsert_frames(existing: DataFrame, new: DataFrame, key=("collection", "chunk_id")) -> tuple[DataFrame, DataFrame]:
    """S8 as a frame: newest version per key wins, of equal versions the new row; rows without a vector are rejected (not indexed).

    Returns (merged index rows, rejected new rows).
    """
    rejected = new.filter(F.col("embedding").isNull())
    good = new.filter(F.col("embedding").isNotNull())
    both = existing.withColumn("_new", F.lit(0)).unionByName(good.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in both.columns if c not in (*key, "_new")]
    # one struct per row, so rows of one version never mix their columns
    merged = both.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("version", "_new")).alias("_row"))
    return merged.select(*key, *[F.col(f"_row.{c}").alias(c) for c in others]), rejected


def collection_counts(index: DataFrame) -> DataFrame:
    """A4: documents per collection."""
    return index.groupBy("collection").agg(F.count("*").cast("long").alias("n_chunks"))


def to_index(resolved_collections: DataFrame, index: DataFrame) -> DataFrame:
    """Collections that still need indexing (those already holding chunks are skipped)."""
    present = index.select("collection").distinct()
    return resolved_collections.join(present, "collection", "left_anti")


def write(index_rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S8/S9 on disk: rewrite only the partitions (collections) present in `index_rows`."""
    index_rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored index, or None if nothing was ever written there. Unreadable files raise."""
    fs, hpath = _file_system(spark, path)
    return spark.read.parquet(path) if fs.exists(hpath) and len(fs.listStatus(hpath)) else None


def upsert(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Merge `new` into the stored collections it touches and rewrite those partitions.

    Returns the rejected rows (no vector). The merged frame is checkpointed
    before the overwrite because it reads the partitions it replaces.
    """
    from slicewise.session import cut_lineage
    # the new rows are computed once (chunking, embedding) and read twice below
    new = cut_lineage(new)
    touched = new.select("collection").distinct()
    old = stored(spark, path)
    old = (spark.createDataFrame([], new.select(*[c for c in INDEX_COLUMNS if c in new.columns]).schema) if old is None
           else old.join(touched, "collection", "left_semi"))
    merged, rejected = upsert_frames(old, new)
    write(cut_lineage(merged), path)
    return rejected


def clear(spark: SparkSession, path: str, collection: str) -> None:
    """Drop a collection and leave it empty (its partition is removed)."""
    fs, hpath = _file_system(spark, f"{path.rstrip('/')}/collection={collection}")
    if fs.exists(hpath):
        fs.delete(hpath, True)



def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk text per experiment collection, for inspection."""
    write(chunks.select("collection", "doc_id", "chunk_index", "chunk_text"), path)
