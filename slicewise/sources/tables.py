"""Table readers and configuration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRATEGY_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("chunk_size", T.IntegerType()),
    T.StructField("chunk_overlap", T.IntegerType()),
    T.StructField("separators", T.ArrayType(T.StringType())),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_path", T.StringType()),
])

# ---------------------------------------------------------------------------
# The shipped strategy configuration (name, method, size, overlap,
# separators, source type, source path), in configuration order.
# ---------------------------------------------------------------------------
SHIPPED_STRATEGIES = [
    (0, "simple_chunk_100_overlap_10", "simple_split", 100, 10, None, None, None),
    (1, "simple_chunk_1", "simple_split", 1000, 200, None, None, None),
    (2, "recursive_char_split_1", "recursive_character_text_splitter", 150, 15,
     ["\n\n", "\n", " ", ""], None, None),
    (3, "embedding_chunk", "outside", None, None, None, "libsql", "data/load_chunks"),
]
# Experiment defaults when a key is missing: rerank, reranker_method, reranker_top_n, retrieval_n_results.
EXPERIMENT_DEFAULTS = {"rerank": False, "reranker_method": "", "reranker_top_n": 4, "retrieval_n_results": 8}
# ---------------------------------------------------------------------------

EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("position", T.LongType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("chunking_strategy", T.StringType()),
    T.StructField("rerank", T.BooleanType()),
    T.StructField("reranker_method", T.StringType()),
    T.StructField("reranker_top_n", T.IntegerType()),
    T.StructField("retrieval_n_results", T.IntegerType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def strategies_table(spark: SparkSession, rows=None) -> DataFrame:
    """Strategy configuration as a (small, broadcastable) table."""
    return spark.createDataFrame(rows if rows is not None else SHIPPED_STRATEGIES, STRATEGY_SCHEMA)


def with_experiment_defaults(experiments: DataFrame) -> DataFrame:
    """M4: fill missing settings; without rerank the reranker is 'Null' with 0 kept."""
    d = EXPERIMENT_DEFAULTS
    rerank = F.coalesce(F.col("rerank"), F.lit(d["rerank"]))
    return (experiments
            .withColumn("rerank", rerank)
            .withColumn("retrieval_n_results", F.coalesce(F.col("retrieval_n_results"), F.lit(d["retrieval_n_results"])))
            .withColumn("reranker_method",
                        F.when(rerank, F.coalesce(F.col("reranker_method"), F.lit(d["reranker_method"])))
                        .otherwise(F.lit("Null")))
            .withColumn("reranker_top_n",
                        F.when(rerank, F.coalesce(F.col("reranker_top_n"), F.lit(d["reranker_top_n"])))
                        .otherwise(F.lit(0))))
