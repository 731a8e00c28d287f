"""Resolve experiments against file types and strategies.

An experiment whose file type is unknown or has no text, or whose strategy or
chunking method is unknown, is rejected with a reason; the rest continue. When a name is defined
twice, the first definition (lowest `position`) wins. All inputs are
configuration-sized except the corpus, which contributes only the distinct
set of file types that have text (a map-side partial aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.functions.text import collection_id, collection_name
from slicewise.operators.chunking import known_methods
from slicewise.sources.tables import with_experiment_defaults

# Reject reasons.
REASON_UNKNOWN_TYPE = "unknown file type"
REASON_NO_TEXT = "no text for file type"
REASON_UNKNOWN_STRATEGY = "unknown strategy"
REASON_UNKNOWN_METHOD = "unknown chunking method"


def first_definition(df: DataFrame, key: str, order: str = "position") -> DataFrame:
    """Keep the first definition of every name (min_by over the position)."""
    others = [c for c in df.columns if c not in (key,)]
    agg = [F.min_by(F.col(c), F.col(order)).alias(c) for c in others]
    return df.groupBy(key).agg(*agg)


def resolve(experiments: DataFrame, file_types: DataFrame, strategies: DataFrame,
            corpus: DataFrame, run_id: str = "run0") -> tuple[DataFrame, DataFrame]:
    """Return (resolved, rejects).

    resolved: experiment columns with defaults + strategy columns + collection (a name) and collection_id (the key).
    rejects: experiment_id, file_type, chunking_strategy, reason.
    """
    exps = with_experiment_defaults(experiments)
    ft = file_types.select(F.col("name").alias("file_type")).distinct()
    with_text = corpus.select("file_type").distinct()
    # Both sides below are configuration-sized outputs of aggregates: AQE measures
    # them at run time and turns the joins into broadcast joins; no hint needed.
    ft = (ft.join(with_text.withColumn("has_text", F.lit(True)), "file_type", "left")
            .withColumn("has_text", F.coalesce(F.col("has_text"), F.lit(False))))
    st = first_definition(strategies, "name")
    st = st.withColumnRenamed("name", "chunking_strategy").drop("position")
    known = ft.select("file_type", "has_text")
    tagged = (exps.join(known, "file_type", "left")
                  .join(st.select("chunking_strategy", F.lit(True).alias("known_strategy"),
                                  F.coalesce(F.col("method").isin(known_methods()), F.lit(False)).alias("known_method")),
                        "chunking_strategy", "left"))
    reason = (F.when(F.col("has_text").isNull(), F.lit(REASON_UNKNOWN_TYPE))
              .when(~F.col("has_text"), F.lit(REASON_NO_TEXT))
              .when(F.col("known_strategy").isNull(), F.lit(REASON_UNKNOWN_STRATEGY))
              .when(~F.col("known_method"), F.lit(REASON_UNKNOWN_METHOD)))
    tagged = tagged.withColumn("reason", reason)
    rejects = tagged.filter(F.col("reason").isNotNull()).select(
        "experiment_id", "file_type", "chunking_strategy", "reason")
    resolved = (tagged.filter(F.col("reason").isNull()).drop("reason", "has_text", "known_strategy", "known_method")
                .join(st, "chunking_strategy")
                .withColumn("collection", collection_name(F.col("file_type"), F.col("chunking_strategy"),
                                                          F.lit(run_id)))
                # names are cut to a length and may collide; the id is what rows are joined on
                .withColumn("collection_id", collection_id(F.col("file_type"), F.col("chunking_strategy"), F.lit(run_id))))
    return resolved, rejects
