"""Ingest chunks cut elsewhere.

A pre-chunked source is any table with an id column, a `pageContent` column
and an order column (its row position). Rows are keyed by id: the last row of
an id wins while the id keeps the position of its first row; rows whose
content is null or empty are dropped; `chunk_index` is the position among the
kept rows. Reported chunking time is 0.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.functions.indexing import dense_index


def ingest(rows: DataFrame, id_col: str, content_col: str = "pageContent", order_col: str = "ord",
           collection_col: str = "collection") -> DataFrame:
    """-> collection, chunk_id, chunk_index, chunk_text, chunk_times_s (0.0)."""
    by_id = rows.groupBy(collection_col, id_col).agg(
        F.max_by(F.col(content_col), F.col(order_col)).alias("chunk_text"),
        F.min(order_col).alias("_first"))
    kept = by_id.filter(F.col("chunk_text").isNotNull() & (F.col("chunk_text") != ""))
    indexed = dense_index(kept, [collection_col], "_first", "chunk_index", orders=rows.select(F.col(order_col).alias("_first")))
    return indexed.select(F.col(collection_col).alias("collection"), F.col(id_col).alias("chunk_id"),
                          "chunk_index", "chunk_text", F.lit(0.0).alias("chunk_times_s"))


# Reader registry keyed by source_type: (spark, source_path) -> rows(collection?, id, pageContent, ord).
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda spark, path: spark.read.parquet(path),
    "json": lambda spark, path: spark.read.json(path),
    "csv": lambda spark, path: spark.read.option("header", True).csv(path),
}


def register_reader(source_type: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[source_type] = reader


def load(spark: SparkSession, source_type: str, source_path: str, collection: str, id_col: str = "id",
         content_col: str = "pageContent", order_col: str = "ord") -> DataFrame:
    if source_type not in READERS:
        raise ValueError(f"Pre-chunked source type '{source_type}' is not supported; register a reader first.")
    rows = READERS[source_type](spark, source_path).withColumn("collection", F.lit(collection))
    return ingest(rows, id_col, content_col, order_col)
