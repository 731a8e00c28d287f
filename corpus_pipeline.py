"""Corpus pipeline: language ID, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between
stages the rows are written as Parquet and read again. All but the last return
the columns of documents.

* language: documents without a letter (`und`) go; so do those whose best language
  explains them no better than the others (posterior under one half). Without labelled texts to learn
  from every document with a letter stays.
* exact: of equal texts (A-Z lower-cased) the row with the largest doc_id stays.
* near: of each near-duplicate component (5-word shingles, similarity 0.8) the document with the
  smallest doc_id stays.
* mix: a row per document and pass of the mix, with the words that the pass takes.
* pack: power-of-two pieces with their ids and the ids' digest.

Defined cases (each stage): those of its operator; an empty table passes through
as an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.llm import exact_dedup, language_id, mixing, near_dedup, packing
from slicewise.llm.common import Scratch
from slicewise.session import configure

MIN_POSTERIOR = 0.5
NEAR_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = language_id.learn(docs)
    if not model.langs:                                  # no labelled text to learn from: nothing is rejected but texts without a letter
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    predicted = language_id.with_language(docs.select(F.struct(*docs.columns).alias("d"), "text"), model)
    return predicted.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_POSTERIOR)).select("d.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return near_dedup.kept_rows(docs, NEAR_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]
#: PPM scores, a mixing schedule and a tokenizer have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
