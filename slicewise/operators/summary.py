"""Roll-up to one summary row per experiment.

Lists are built per experiment (at most the sampled QA count) in QA order.
The score ratio is sum(score) / (2 * scored QAs); unresolved judgements
(null score) are left out of both sums, and an experiment with no scored QA
keeps its row with a null ratio.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The maximum judge score, and the configured summary column order.
MAX_SCORE = 2
SUMMARY_COLUMNS = [
    "file_type_name", "chunking_strategy_name", "chunking_method", "chunk_size", "chunk_overlap",
    "chunk_times_s", "chunk_retrieval_nums", "reranker_model", "reranker_nums", "chunking_params",
    "cosine_similaritys", "llm_evaluation_scores", "llm_score_ratio",
]


def _ordered_list(value: str, order: str = "qa_id") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))),
                       lambda s: s["v"])


def per_experiment(metrics: DataFrame, key: str = "experiment_id") -> DataFrame:
    """A2 + A3: metrics (key, qa_id, cosine_similarity, llm_score) -> lists and ratio."""
    return metrics.groupBy(key).agg(
        F.count("*").cast("long").alias("n_questions"),
        _ordered_list("cosine_similarity").alias("cosine_similaritys"),
        _ordered_list("llm_score").alias("llm_evaluation_scores"),
        (F.sum("llm_score") / (F.lit(MAX_SCORE) * F.count("llm_score"))).alias("llm_score_ratio"))


def chunking_params(method: Column, size: Column, overlap: Column, separators: Column) -> Column:
    """The strategy parameters rendered as a Python dict literal ('{}' for outside sources)."""
    seps = F.concat(F.lit(", 'separators': ["),
                    F.array_join(F.transform(separators, lambda s: F.concat(
                        F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")),
                        F.lit("'"))), ", "),
                    F.lit("]"))
    body = F.concat(F.lit("{'chunk_size': "), size.cast("string"), F.lit(", 'chunk_overlap': "), overlap.cast("string"),
                    F.when(separators.isNotNull(), seps).otherwise(F.lit("")), F.lit("}"))
    return F.when(method == "outside", F.lit("{}")).otherwise(body)


def assemble(resolved: DataFrame, rolled: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Configuration columns + rolled-up metrics per experiment."""
    out = resolved.join(rolled, "experiment_id", "left")
    if timings is not None:
        out = out.join(timings, "chunking_strategy", "left")
    else:
        out = out.withColumn("chunk_times_s", F.lit(None).cast("double"))
    return out.select(
        "experiment_id",
        F.col("file_type").alias("file_type_name"),
        F.col("chunking_strategy").alias("chunking_strategy_name"),
        F.col("method").alias("chunking_method"),
        F.col("chunk_size").cast("long"), F.col("chunk_overlap").cast("long"),
        "chunk_times_s",
        F.col("retrieval_n_results").cast("long").alias("chunk_retrieval_nums"),
        F.col("reranker_method").alias("reranker_model"),
        F.col("reranker_top_n").cast("long").alias("reranker_nums"),
        chunking_params(F.col("method"), F.col("chunk_size"), F.col("chunk_overlap"), F.col("separators"))
        .alias("chunking_params"),
        *[c for c in rolled.columns if c != "experiment_id"])


def order_columns(df: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """Configured columns first (all required), extra columns after in arrival order."""
    configured = configured if configured is not None else SUMMARY_COLUMNS
    missing = [c for c in configured if c not in df.columns]
    if missing:
        raise ValueError(f"the summary lacks configured columns: {', '.join(missing)}")
    return df.select(*configured, *[c for c in df.columns if c not in configured])


def result_name(when: datetime.datetime) -> str:
    """The name of a batch's result, with the time at which the batch began."""
    return f"experiment_results_{when:%Y%m%d_%H%M%S_%f}"


def write_csv(summary: DataFrame, path: str, when: datetime.datetime | None = None) -> str:
    """One CSV per batch under `path`, named by time; header with byte-order mark, arrays as JSON text.

    The rows (one per experiment) are dealt to one task by an exchange, so the stages
    before keep their parallelism. Returns the folder written.
    """
    flat = summary.select(*[F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "array"
                            else F.col(f.name) for f in summary.schema.fields])
    # Spark has no byte-order mark option: the mark is the first character of the header
    flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    target = f"{path.rstrip('/')}/{result_name(when or datetime.datetime.now())}"
    flat.repartition(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(target)
    return target


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Append result rows whose columns differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
