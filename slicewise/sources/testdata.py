"""Stand-ins: the driver's tables in the roles of the reference's inputs.

* documents      -> corpus; `source` is the file type (many documents per type).
* conversations  -> QA pairs: a user turn is a question, the following
                    assistant turn its answers (one answer per line).
                    QA sets are tied to file types by `conv_id % n_types`
                    over the sorted file-type names (the reference keeps one
                    QA file per file type; the tables carry no such link).
* embeddings     -> chunk vectors; `label` is the collection.
* benchmark      -> reference passages (recall).
Model replies (chat, judge, QA generation) are synthesised from table columns
by string expressions that the DuckDB oracle repeats verbatim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.functions.sizing import spread
from slicewise.sources.tables import read_table

# ---------------------------------------------------------------------------
# Experiment settings applied to every file type of the corpus
# (setting number, strategy name, rerank, reranker method, top n, k).
# ---------------------------------------------------------------------------
SETTINGS = [
    (0, "simple_chunk_100_overlap_10", False, None, None, 8),
    (1, "simple_chunk_1", False, None, None, 8),
    (2, "recursive_char_split_1", False, None, None, 8),
    (3, "simple_chunk_1", True, "lexical", 4, 8),
    (4, "simple_chunk_100_overlap_0", False, None, None, 8),   # unknown strategy -> reject
]
MISSING_FILE_TYPE = "rules_complex"   # declared, no text -> reject
VECTOR_DIMS = 64                       # length of the driver's embeddings
N_FILE_TYPES = 20                      # distinct `source` values in the driver corpus
# ---------------------------------------------------------------------------


#: One id per (conversation, turn): turns stay below this step.
TURN_KEY_STEP = 1 << 32


def turn_key(conv_id, turn):
    return conv_id * F.lit(TURN_KEY_STEP) + turn


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("file_type"), "text", "n_chars", "lang")
    return spread(docs, "doc_id")


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: one row per file type; `path` names its text (S2 takes the stem)."""
    names = read_table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    names = names.unionByName(spark.range(1).select(F.lit(MISSING_FILE_TYPE).alias("name")))
    return names.select(
        "name",
        F.concat(F.lit("documents of source "), F.col("name")).alias("description"),
        F.concat(F.lit("data/"), F.col("name"), F.lit(".txt")).alias("path"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: every setting for every file type, plus one declared type with no text."""
    settings = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(s).alias("chunking_strategy"), F.lit(r).alias("rerank"),
                 F.lit(m).cast("string").alias("reranker_method"), F.lit(t).cast("int").alias("reranker_top_n"),
                 F.lit(k).alias("retrieval_n_results"))
        for n, s, r, m, t, k in SETTINGS])
    types = file_types(spark, sf_dir).select(F.col("name").alias("file_type"))
    exploded = types.select("file_type", F.explode(settings).alias("s"))
    return exploded.select(
        F.concat(F.col("file_type"), F.lit("#"), F.col("s.n")).alias("experiment_id"),
        F.col("s.n").cast("long").alias("position"),
        "file_type", "s.chunking_strategy", "s.rerank", "s.reranker_method", "s.reranker_top_n",
        "s.retrieval_n_results")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qa_id, file_type, question, answers) from user -> assistant turns."""
    conv = read_table(spark, sf_dir, "conversations")
    q = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_text"))
    return (q.join(a, ["conv_id", "turn"])
            .select(turn_key(F.col("conv_id"), F.col("turn")).alias("qa_id"),
                    F.concat(F.lit("src"), (F.col("conv_id") % N_FILE_TYPES).cast("string")).alias("file_type"),
                    "question",
                    F.split(F.col("answer_text"), "\n", -1).alias("answers")))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors with a collection: (collection, chunk_id, chunk_index, embedding)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("collection"),
                      F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("chunk_index"),
                      F.col("label"), "embedding")
