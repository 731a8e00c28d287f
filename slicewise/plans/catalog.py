"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or frames Spark derives from them) in
full; the matching DuckDB statement lives in `plans.oracle`.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.operators import chunking
from slicewise.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(method: str, size: int, overlap: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = (testdata.corpus(spark, sf_dir).select("doc_id", "text")
                .withColumn("chunk_size", F.lit(size)).withColumn("chunk_overlap", F.lit(overlap)))
        out = chunking.split_text(docs, method)
        return out.select("doc_id", F.col("chunk_index").cast("long"),
                          F.length("chunk_text").cast("long").alias("chunk_chars"), "chunk_text")
    return run


def _chunks_by_fragments(method: str, size: int, overlap: int, fragment_chars: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from slicewise.operators.long_documents import split_long_text
        docs = (testdata.corpus(spark, sf_dir).select("doc_id", "text")
                .withColumn("chunk_size", F.lit(size)).withColumn("chunk_overlap", F.lit(overlap)))
        out = split_long_text(docs, method, fragment_chars=fragment_chars)
        return out.select("doc_id", F.col("chunk_index").cast("long"),
                          F.length("chunk_text").cast("long").alias("chunk_chars"), "chunk_text")
    return run


QUERIES: dict[str, Query] = {
    "chunk_lines_1000_200": _chunks(chunking.LINE_MERGE, 1000, 200),
    "chunk_lines_100_10": _chunks(chunking.LINE_MERGE, 100, 10),
    "chunk_recursive_150_15": _chunks(chunking.RECURSIVE, 150, 15),
}
# every document in fragments of a few pages, so that most of them span several
QUERIES["chunk_lines_by_fragments"] = _chunks_by_fragments(chunking.LINE_MERGE, 100, 10, 8192)
QUERIES["chunk_recursive_by_fragments"] = _chunks_by_fragments(chunking.RECURSIVE, 150, 15, 8192)
FLAGSHIP = "flagship_strategy_ranking"


# --------------------------------------------------------------------------- experiments
RUN_ID = "run0"


def resolved_experiments(spark: SparkSession, sf_dir: str):
    from slicewise.operators.experiments import resolve
    from slicewise.sources.tables import strategies_table
    return resolve(testdata.experiments(spark, sf_dir), testdata.file_types(spark, sf_dir),
                   strategies_table(spark), testdata.corpus(spark, sf_dir), RUN_ID)


def q_resolve_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved, _ = resolved_experiments(spark, sf_dir)
    return resolved.select(
        "experiment_id", "file_type", "chunking_strategy", "method",
        F.col("chunk_size").cast("long"), F.col("chunk_overlap").cast("long"), "rerank", "reranker_method",
        F.col("reranker_top_n").cast("long"), F.col("retrieval_n_results").cast("long"), "collection")


def q_experiment_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = resolved_experiments(spark, sf_dir)
    return rejects


def collection_chunks(spark: SparkSession, sf_dir: str, strategies: list[str] | None = None) -> DataFrame:
    """Every (file type, strategy) pair of the resolved experiments, chunked once.

    Output: collection, collection_id, file_type, chunking_strategy, doc_id, original_text_length,
    chunk_index, chunk_text. strategies: only these.
    """
    lists = collection_chunk_lists(spark, sf_dir, strategies)
    return chunking.exploded(lists, ["collection", "collection_id", "file_type", "chunking_strategy", "doc_id", "original_text_length"])


def collection_chunk_lists(spark: SparkSession, sf_dir: str, strategies: list[str] | None = None) -> DataFrame:
    """The same before the chunks become rows: one row per (collection, document) with its text and `chunks`."""
    joined, rows = collection_documents(spark, sf_dir, strategies)
    return chunking.pair_chunk_lists(joined, rows).drop("method", "separators", "chunk_size", "chunk_overlap")


def collection_documents(spark: SparkSession, sf_dir: str, strategies: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """One row per (collection, document) with its text and strategy, and the strategies."""
    from slicewise.sources.tables import SHIPPED_STRATEGIES, STRATEGY_SCHEMA
    from slicewise.session import cut_lineage
    resolved, _ = resolved_experiments(spark, sf_dir)
    if strategies:
        resolved = resolved.filter(F.col("chunking_strategy").isin(strategies))
    # configuration-sized: materialised once, so Spark knows its size when it plans the join
    pairs = cut_lineage(resolved.filter(F.col("method") != chunking.OUTSIDE).select(
        "collection", "collection_id", "file_type", "chunking_strategy", "method", "chunk_size", "chunk_overlap",
        "separators").distinct())
    docs = testdata.corpus(spark, sf_dir).select(
        "doc_id", "file_type", "text", F.col("n_chars").alias("original_text_length"))
    return docs.join(pairs, "file_type"), [dict(zip(STRATEGY_SCHEMA.fieldNames(), r)) for r in SHIPPED_STRATEGIES]


def q_chunk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a document's chunks are counted in its row; only one row per document and strategy is grouped
    sizes = F.transform("chunks", lambda c: F.length(c))
    per_doc = (collection_chunk_lists(spark, sf_dir).select("file_type", "chunking_strategy", sizes.alias("s"))
               .filter(F.size("s") > 0)
               .select("file_type", "chunking_strategy", F.size("s").alias("n"), F.array_max("s").alias("mx"),
                       F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars")))
    return per_doc.groupBy("file_type", "chunking_strategy").agg(
        F.count("*").cast("long").alias("n_docs"),
        F.sum("n").cast("long").alias("n_chunks"),
        F.sum("chars").cast("long").alias("total_chars"),
        F.max("mx").cast("long").alias("max_chars"),
        F.round(F.sum("chars") / F.sum("n"), 6).alias("avg_chars"))


def q_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P2 + P3: collection name, chunk metadata and deterministic chunk id."""
    from slicewise.functions.text import chunk_id
    chunks = collection_chunks(spark, sf_dir)
    return chunks.select(
        "collection",
        chunk_id(F.col("collection_id"), F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        F.col("file_type").alias("source_file_type"), "chunking_strategy", "doc_id",
        F.col("chunk_index").cast("long"), F.col("original_text_length").cast("long"))


QUERIES.update({
    "resolve_experiments": q_resolve_experiments,
    "experiment_rejects": q_experiment_rejects,
    "chunk_matrix": q_chunk_matrix,
    "chunk_ids": q_chunk_ids,
})


# --------------------------------------------------------------------------- sources / QA
def q_prechunked_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: conversations as a pre-chunked `vectors` table keyed by conv_id."""
    from slicewise.sources import prechunked
    from slicewise.sources.tables import read_table
    rows = read_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("collection"), F.col("conv_id").alias("id"),
        F.col("text").alias("pageContent"), testdata.turn_key(F.col("conv_id"), F.col("turn")).alias("ord"))
    out = prechunked.ingest(rows, "id")
    return out.select("collection", "chunk_id", "chunk_index", "chunk_text", "chunk_times_s")


def conversation_qa_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy QA text files rendered from conversations: one file per conversation."""
    from slicewise.sources.tables import read_table
    conv = read_table(spark, sf_dir, "conversations")
    line = (F.when(F.col("role") == "user", F.concat(F.lit("Q: "), F.col("text")))
            .when(F.col("role") == "assistant", F.concat(
                F.lit("A: ["), F.array_join(F.transform(F.split(F.col("text"), "\n", -1),
                                                          lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                F.lit("]")))
            .otherwise(F.concat(F.lit("S: "), F.col("text"))))
    files = conv.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))),
                                 lambda s: s["line"]), "\n").alias("value"))
    return files.select(F.concat(F.lit("qa/conv_"), F.col("conv_id").cast("string"), F.lit("_qa_pairs.txt")).alias("path"),
                        "value")


def q_qa_file_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.sources import qa_text
    parsed = qa_text.parse(conversation_qa_files(spark, sf_dir))
    return parsed.select("path", "qa_index", "question",
                         F.array_join("answers", "\u001f").alias("answers_text"),
                         F.size("answers").cast("long").alias("n_answers"))


def q_qa_sample_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators import qa
    return qa.sample(testdata.qa_pairs(spark, sf_dir)).select("file_type", "qa_id", "question", "sample_rank")


QUERIES.update({
    "prechunked_ingest": q_prechunked_ingest,
    "qa_file_parse": q_qa_file_parse,
    "qa_sample_8": q_qa_sample_8,
})


# --------------------------------------------------------------------------- metrics
def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in (standard answers, generated answer) pairs: the generated answer echoes the question."""
    from slicewise.operators.similarity import joined_answers
    qa_all = testdata.qa_pairs(spark, sf_dir)
    return qa_all.select("qa_id", joined_answers(F.col("answers")).alias("std_text"),
                         F.col("question").alias("final_answer"))


def q_answer_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators.similarity import text_pair_cosine
    cos = text_pair_cosine(answer_pairs(spark, sf_dir), "qa_id", "std_text", "final_answer")
    return cos.select("qa_id", F.round("cosine_similarity", 6).alias("cosine_similarity"))


def q_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators.similarity import token_overlap
    m = answer_pairs(spark, sf_dir).select("qa_id", token_overlap(F.col("std_text"), F.col("final_answer")).alias("m"))
    return m.select("qa_id", *[F.round(F.col("m." + c), 6).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


def q_chunk_vs_original_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + A11: chunks per collection and mean TF-IDF cosine of chunk vs its document."""
    from slicewise.operators.similarity import pair_chunk_cosines
    cos = pair_chunk_cosines(*collection_documents(spark, sf_dir)).select("collection", F.col("cosines").alias("c"))
    per_doc = cos.filter(F.size("c") > 0).select("collection", F.size("c").alias("n"),
                                                 F.aggregate("c", F.lit(0.0), lambda a, x: a + x).alias("s"))
    return per_doc.groupBy("collection").agg(
        F.sum("n").cast("long").alias("n_chunks"),
        F.round(F.sum("s") / F.sum("n"), 6).alias("mean_cosine"))


QUERIES.update({
    "answer_cosine": q_answer_cosine,
    "token_overlap": q_token_overlap,
    "chunk_vs_original_cosine": q_chunk_vs_original_cosine,
})


# --------------------------------------------------------------------------- retrieval
def _centroid_queries(spark: SparkSession, sf_dir: str):
    from slicewise.operators.retrieval import centroids
    from slicewise.session import cut_lineage
    vecs = testdata.chunk_vectors(spark, sf_dir)
    # one row per collection, materialised: computed once and of known size
    queries = cut_lineage(centroids(vecs, "collection").withColumn("query_id", F.col("collection")))
    return queries, vecs


def _knn_out(hits: DataFrame, *included) -> DataFrame:
    return hits.select("query_id", "collection", F.col("rank").cast("long"), "chunk_id", "chunk_index",
                       F.round("distance", 6).alias("distance"), *included)


def q_knn_exact_k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators.retrieval import knn
    queries, vecs = _centroid_queries(spark, sf_dir)
    return _knn_out(knn(queries, vecs, 8, dims=testdata.VECTOR_DIMS))


def q_knn_k_exceeds_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators.retrieval import knn
    queries, vecs = _centroid_queries(spark, sf_dir)
    return _knn_out(knn(queries, vecs, None, dims=testdata.VECTOR_DIMS))


def q_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection holding every vector; each query filters on its own `label` metadata."""
    from slicewise.operators.retrieval import knn
    queries, vecs = _centroid_queries(spark, sf_dir)
    everything = vecs.withColumn("collection", F.lit("all"))
    q = queries.select("query_id", "query_vector",
                       F.regexp_extract("collection", r"(\d+)$", 1).cast("int").alias("filter_label"),
                       F.lit("all").alias("collection"))
    hits = knn(q, everything, 8, where_query={"label": "filter_label"}, include=("label",), dims=testdata.VECTOR_DIMS)
    return _knn_out(hits, F.col("label").cast("long").alias("label"))


def _id_queries(spark: SparkSession, sf_dir: str):
    """The stored vectors whose id is divisible by 50, as questions to their collections."""
    from slicewise.session import cut_lineage
    vecs = testdata.chunk_vectors(spark, sf_dir)
    asked = vecs.filter(F.col("chunk_id") % 50 == 0).select("collection", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return cut_lineage(asked), vecs


def q_knn_ids_k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators.retrieval import knn
    queries, vecs = _id_queries(spark, sf_dir)
    return _knn_out(knn(queries, vecs, 8, dims=testdata.VECTOR_DIMS))


def q_knn_ids_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 on every vector with an id divisible by 50: recall@8 against the exact neighbours."""
    return _lsh_recall(*_id_queries(spark, sf_dir))


def _stored_index(spark: SparkSession, vecs: DataFrame) -> str:
    from slicewise.session import note_table
    from slicewise.sources import inverted_file
    path = note_table(inverted_file.scratch_path(spark))
    inverted_file.build(vecs, path, testdata.VECTOR_DIMS)
    return path


def q_index_ids_k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 on the stored inverted file: cells and rows out of reach are skipped, the answer is that of a scan."""
    from slicewise.sources import inverted_file
    queries, vecs = _id_queries(spark, sf_dir)
    path = _stored_index(spark, vecs)
    return _knn_out(inverted_file.search(spark, path, queries, 8, testdata.VECTOR_DIMS, exact=True))


def q_index_recall_ids_k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 on the stored inverted file: rows returned, and whether recall@8 over all questions is at least 0.9."""
    from slicewise.operators.retrieval import knn
    from slicewise.sources import inverted_file
    queries, vecs = _id_queries(spark, sf_dir)
    path = _stored_index(spark, vecs)
    inverted_file.calibrate(spark, path, 8, testdata.VECTOR_DIMS)
    exact = knn(queries, vecs, 8, dims=testdata.VECTOR_DIMS).select("query_id", "chunk_id", F.lit(1).alias("_exact"))
    approx = inverted_file.search(spark, path, queries, 8, testdata.VECTOR_DIMS).select("query_id", "chunk_id", F.lit(1).alias("_approx"))
    both = exact.join(approx, ["query_id", "chunk_id"], "full")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("_exact").alias("n_exact"), F.count("_approx").alias("n_returned"),
                    (F.count(F.col("_exact") + F.col("_approx")) >= 0.9 * F.count("_exact")).alias("recall_reached"))


def q_knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours; recall@8 of the LSH top-8 against the exact top-8."""
    return _lsh_recall(*_centroid_queries(spark, sf_dir))


def _lsh_recall(queries: DataFrame, vecs: DataFrame) -> DataFrame:
    from slicewise.operators.retrieval import knn, knn_lsh
    exact = knn(queries, vecs, 8, dims=testdata.VECTOR_DIMS).select("query_id", "chunk_id")
    approx = knn_lsh(queries, vecs, 8, testdata.VECTOR_DIMS).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    j = exact.join(approx, ["query_id", "chunk_id"], "left")
    return j.groupBy("query_id").agg(
        F.count("*").cast("long").alias("n_exact"), F.count("hit").cast("long").alias("n_found"),
        F.round(F.count("hit") / F.count("*"), 6).alias("recall_at_8"))


def q_knn_mixed_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 with a k of its own per query; every seventh vector is missing, every eleventh misses a component."""
    from slicewise.operators.retrieval import knn
    queries, vecs = _centroid_queries(spark, sf_dir)
    e = F.col("embedding")
    holes = (F.when(F.col("chunk_id") % 7 == 0, F.lit(None).cast("array<float>"))
             .when(F.col("chunk_id") % 11 == 0, F.concat(F.slice(e, 1, testdata.VECTOR_DIMS - 1), F.array(F.lit(None).cast("float"))))
             .when(F.col("chunk_id") % 13 == 0, F.slice(e, 1, testdata.VECTOR_DIMS - 1)).otherwise(e))
    q = queries.withColumn("k", F.regexp_extract("query_id", r"(\d+)$", 1).cast("int") % 8 + 1)
    return _knn_out(knn(q, vecs.withColumn("embedding", holes), "k", dims=testdata.VECTOR_DIMS))


def q_knn_unscorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-17: the vectors that the search above leaves out, with the reason."""
    from slicewise.operators.retrieval import unscorable
    e = F.col("embedding")
    holes = (F.when(F.col("chunk_id") % 7 == 0, F.lit(None).cast("array<float>"))
             .when(F.col("chunk_id") % 11 == 0, F.concat(F.slice(e, 1, testdata.VECTOR_DIMS - 1), F.array(F.lit(None).cast("float"))))
             .when(F.col("chunk_id") % 13 == 0, F.slice(e, 1, testdata.VECTOR_DIMS - 1)).otherwise(e))
    v = testdata.chunk_vectors(spark, sf_dir).withColumn("embedding", holes)
    return unscorable(v, dims=testdata.VECTOR_DIMS).select("collection", "chunk_id", "reason")


QUERIES.update({
    "knn_ids_k8": q_knn_ids_k8,
    "knn_ids_lsh": q_knn_ids_lsh,
    "index_ids_k8": q_index_ids_k8,
    "index_recall_ids_k8": q_index_recall_ids_k8,
    "knn_mixed_k": q_knn_mixed_k,
    "knn_unscorable": q_knn_unscorable,
    "knn_exact_k8": q_knn_exact_k8,
    "knn_k_exceeds_size": q_knn_k_exceeds_size,
    "knn_filtered": q_knn_filtered,
    "knn_lsh": q_knn_lsh,
})


# --------------------------------------------------------------------------- model replies
def q_chat_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.functions.replies import chat_envelope
    from slicewise.sources.model_replies import chat_responses
    r = chat_responses(spark, sf_dir).select("request_id", chat_envelope(F.col("body")).alias("e"))
    return r.select("request_id", "e.valid", "e.tokens_used", "e.gen_model", "e.ans_content", "e.thinking_content")


def q_embedding_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.functions.replies import embedding_envelope
    from slicewise.sources.model_replies import embedding_responses
    r = embedding_responses(spark, sf_dir).select("chunk_id", embedding_envelope(F.col("body")).alias("e"))
    emb = F.col("e.embedding")
    return r.select("chunk_id", "e.valid", "e.tokens_used", "e.model",
                    F.size(emb).cast("long").alias("n_dims"),
                    F.round(F.aggregate(emb, F.lit(0.0), lambda a, x: a + x), 6).alias("sum_embedding"),
                    F.round(F.element_at(emb, 1), 6).alias("first_value"))


def _qa_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.functions.replies import qa_items
    from slicewise.sources.model_replies import qa_generation_replies
    return qa_generation_replies(spark, sf_dir).select("conv_id", qa_items(F.col("reply")).alias("x"))


def q_qa_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.functions.replies import qa_answers, qa_question
    x = _qa_extracted(spark, sf_dir).select("conv_id", F.posexplode("x.items").alias("qa_index", "item"))
    answers = qa_answers(F.col("item"))
    return x.select("conv_id", F.col("qa_index").cast("long"), qa_question(F.col("item")).alias("question"),
                    F.array_join(answers, "\u001f").alias("answers_text"), F.size(answers).cast("long").alias("n_answers"))


def q_qa_extract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _qa_extracted(spark, sf_dir)
    return x.select("conv_id", F.col("x.branch").alias("branch"), F.size("x.items").cast("long").alias("n_pairs"))


def q_score_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators.judge import parse_judgements
    from slicewise.sources.model_replies import judge_replies
    return parse_judgements(judge_replies(spark, sf_dir)).select(
        "qa_id", "attempt", "valid", "score", "justification", "branch")


def q_score_pending_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slicewise.operators.judge import accept, parse_judgements
    from slicewise.sources.model_replies import judge_replies
    return accept(parse_judgements(judge_replies(spark, sf_dir)), "qa_id").select(
        "qa_id", "attempts_seen", "accepted_attempt", "score", "resolved")


def q_judge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds driven against a table of replies: only pending requests are asked again."""
    from slicewise.operators.judge import run_rounds
    from slicewise.sources.model_replies import judge_replies
    replies = judge_replies(spark, sf_dir)
    requests = replies.select("qa_id").distinct()
    ask = lambda todo, attempt: replies.filter(F.col("attempt") == attempt).join(todo, "qa_id", "left_semi")
    return run_rounds(requests, ask, "qa_id").select("qa_id", "attempts_seen", "accepted_attempt", "score", "resolved")


QUERIES.update({
    "judge_rounds": q_judge_rounds,
    "chat_envelope": q_chat_envelope,
    "embedding_envelope": q_embedding_envelope,
    "qa_extract": q_qa_extract,
    "qa_extract_fallback": q_qa_extract_fallback,
    "score_extract": q_score_extract,
    "score_pending_retry": q_score_pending_retry,
})


# --------------------------------------------------------------------------- flagship
def _fmt_list(c: str) -> "F.Column":
    return F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x)), ",")


def flagship_summary(spark: SparkSession, sf_dir: str, batch=None) -> DataFrame:
    from slicewise.plans import experiment_batch
    from slicewise.sources.tables import strategies_table
    return experiment_batch.run(
        spark, testdata.corpus(spark, sf_dir), testdata.file_types(spark, sf_dir), strategies_table(spark),
        testdata.experiments(spark, sf_dir), testdata.qa_pairs(spark, sf_dir), batch)


def q_flagship_strategy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All experiments end to end; one row per experiment (timings left out: not deterministic)."""
    s = flagship_summary(spark, sf_dir)
    return s.select(
        "experiment_id", "file_type_name", "chunking_strategy_name", "chunking_method", "chunk_size",
        "chunk_overlap", "chunk_retrieval_nums", "reranker_model", "reranker_nums", "chunking_params",
        "n_chunks", "n_questions",
        _fmt_list("cosine_similaritys").alias("cosine_similaritys"),
        _fmt_list("llm_evaluation_scores").alias("llm_evaluation_scores"),
        F.round("llm_score_ratio", 6).alias("llm_score_ratio"),
        F.round("qa_recall", 6).alias("qa_recall"),
        F.round("topk_vs_original", 6).alias("topk_vs_original"),
        "embedder")


QUERIES["flagship_strategy_ranking"] = q_flagship_strategy_ranking


def _batch_frames(spark: SparkSession, sf_dir: str):
    from slicewise.plans import experiment_batch
    from slicewise.sources.tables import strategies_table
    b = experiment_batch.Batch()
    experiment_batch.run(
        spark, testdata.corpus(spark, sf_dir), testdata.file_types(spark, sf_dir), strategies_table(spark),
        testdata.experiments(spark, sf_dir), testdata.qa_pairs(spark, sf_dir), b, stop_after="retrieval")
    return b.frames


def q_retrieve_lexical_k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 + J2 + T1 on chunk texts: hashed-TF vectors, top-8 per sampled question in its collection."""
    h = _batch_frames(spark, sf_dir)["hits"]
    return h.select("query_id", "collection", "chunk_id", F.col("rank").cast("long"),
                    F.round("distance", 6).alias("distance"))


def q_rerank_lexical_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: lexical rerank of the top-8 hits, keeping 4, for the experiments that ask for it."""
    k = _batch_frames(spark, sf_dir)["kept"].filter(F.col("rerank"))
    return k.select("query_id", "chunk_id", F.col("rank").cast("long"), F.col("rerank_rank").cast("long"),
                    F.round("score", 6).alias("score"))


def q_rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + J4 + T4 fallback: rerank from a response table; empty or broken responses keep the hits."""
    from slicewise.operators import rerank as rr
    frames = _batch_frames(spark, sf_dir)
    hits = frames["hits"].filter(F.col("rerank"))
    scores = rr.lexical_scores(hits)
    ordered = scores.withColumn("qa_id", F.element_at(F.split("query_id", r"\|"), 2).cast("long"))
    items = ordered.groupBy("query_id", "qa_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.round(F.col("score"), 12)).alias("ns"), F.col("rank").alias("r"),
                                             F.col("score").alias("s")))),
        lambda s: F.concat(F.lit('{"index": '), (s["r"] - 1).cast("string"), F.lit(', "relevance_score": '),
                           F.format_string("%.6f", s["s"]), F.lit("}"))), ", ").alias("items"))
    body = (F.when(F.col("qa_id") % 3 == 0, F.lit('{"results": []}'))
            .when(F.col("qa_id") % 3 == 1, F.lit("not json"))
            .otherwise(F.concat(F.lit('{"results": ['), F.col("items"), F.lit("]}"))))
    responses = items.select("query_id", body.alias("body"))
    table_scores = rr.scores_from_results(rr.parse_rerank_response(responses))
    kept = rr.rerank(hits, "reranker_top_n", scores=table_scores)
    used = table_scores.select("query_id").distinct().withColumn("from_table", F.lit(True))
    return (kept.join(used, "query_id", "left")
            .select("query_id", "chunk_id", F.col("rank").cast("long"), F.col("rerank_rank").cast("long"),
                    F.coalesce("from_table", F.lit(False)).alias("from_table")))


def q_context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 + A5 + P14: context per question, counts and status."""
    c = _batch_frames(spark, sf_dir)["context"]
    return c.select("query_id", F.size("context").cast("long").alias("n_context"), "retrieved_count",
                    "reranked_count", "status",
                    F.md5(F.array_join("context", "\u001f")).alias("context_md5"))


def q_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + P5 + P6: the RAG prompt of every question, cut to 8192 characters."""
    p = _batch_frames(spark, sf_dir)["prompts"]
    return p.select("query_id", F.length("prompt").cast("long").alias("prompt_chars"), "truncated",
                    F.md5("prompt").alias("prompt_md5"))


# --------------------------------------------------------------------------- index and QA policies
def q_index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + A4 (+ P8, D-17): re-embed a collection from parsed envelopes and upsert; vector-less rows rejected."""
    from slicewise.functions.replies import embedding_envelope
    from slicewise.sources import vector_index
    from slicewise.sources.model_replies import embedding_responses
    old = testdata.chunk_vectors(spark, sf_dir).select(
        "collection", "chunk_id", "chunk_index", "embedding", F.lit(0).alias("version"))
    env = embedding_responses(spark, sf_dir).select("chunk_id", embedding_envelope(F.col("body")).alias("e"))
    new = (env.join(old.select("collection", "chunk_id", "chunk_index"), "chunk_id")
           .select("collection", "chunk_id", "chunk_index", F.col("e.embedding").cast("array<float>").alias("embedding"),
                   F.lit(1).alias("version")))
    merged, rejected = vector_index.upsert_frames(old, new)
    counts = vector_index.collection_counts(merged)
    from_new = merged.filter(F.col("version") == 1).groupBy("collection").agg(
        F.count("*").cast("long").alias("n_from_new"))
    rej = rejected.groupBy("collection").agg(F.count("*").cast("long").alias("n_rejected"))
    return (counts.join(from_new, "collection", "left").join(rej, "collection", "left")
            .select("collection", "n_chunks", F.coalesce("n_from_new", F.lit(0).cast("long")).alias("n_from_new"),
                    F.coalesce("n_rejected", F.lit(0).cast("long")).alias("n_rejected")))


def q_index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S9 on the versioned index: a re-embedding upsert, one collection cleared, compacted; the first snapshot read beside the last."""
    from slicewise.functions.replies import embedding_envelope
    from slicewise.session import checkpoint_dir, note_table
    from slicewise.sources import versioned_index
    from slicewise.sources.model_replies import embedding_responses
    path = note_table(f"{checkpoint_dir(spark).rstrip('/')}/slicewise-tables/versions-{uuid.uuid4().hex}")
    old = testdata.chunk_vectors(spark, sf_dir).select("collection", "chunk_id", "chunk_index", "embedding", F.lit(0).alias("version"))
    env = embedding_responses(spark, sf_dir).select("chunk_id", embedding_envelope(F.col("body")).alias("e"))
    new = (env.join(old.select("collection", "chunk_id", "chunk_index"), "chunk_id")
           .select("collection", "chunk_id", "chunk_index", F.col("e.embedding").cast("array<float>").alias("embedding"),
                   F.lit(1).alias("version")))
    versioned_index.upsert(spark, path, old)
    versioned_index.upsert(spark, path, new)
    versioned_index.clear(spark, path, "label_5")
    versioned_index.compact(spark, path)
    n = F.count("*").cast("long")
    first = versioned_index.read(spark, path, 1).groupBy("collection").agg(n.alias("n_before"))
    last = versioned_index.read(spark, path).groupBy("collection").agg(
        n.alias("n_chunks"), F.count_if(F.col("version") == 1).cast("long").alias("n_from_new"))
    zero = F.lit(0).cast("long")
    return first.join(last, "collection", "left").select(
        "collection", "n_before", F.coalesce("n_chunks", zero).alias("n_chunks"), F.coalesce("n_from_new", zero).alias("n_from_new"))


def q_index_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + A4: a previous run indexed the line-merge 100/10 collections; only the others are indexed now."""
    from slicewise.sources import vector_index
    from slicewise.session import cut_lineage
    resolved, _ = resolved_experiments(spark, sf_dir)
    wanted = cut_lineage(resolved.filter(F.col("method") != chunking.OUTSIDE).select("collection", "chunking_strategy").distinct())
    # what the previous run stored; which collections to index is decided from their names alone, before any chunking
    chunks = collection_chunks(spark, sf_dir, strategies=["simple_chunk_100_overlap_10"])
    existing = cut_lineage(chunks.select("collection", "doc_id", "chunk_index"))
    wanted = wanted.select("collection").distinct()
    todo = vector_index.to_index(wanted, existing).withColumn("action", F.lit("index"))
    present = vector_index.collection_counts(existing)
    skipped = wanted.join(present, "collection").select("collection").withColumn("action", F.lit("skip"))
    return (todo.unionByName(skipped).join(present, "collection", "left")
            .select("collection", "action", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_existing")))


def _generated_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA pairs parsed from generation replies (P10), keyed by file type."""
    from slicewise.functions.replies import qa_answers, qa_question
    x = _qa_extracted(spark, sf_dir).select("conv_id", F.posexplode("x.items").alias("qa_index", "item"))
    return x.select(F.concat(F.lit("src"), (F.col("conv_id") % testdata.N_FILE_TYPES).cast("string")).alias("file_type"),
                    testdata.turn_key(F.col("conv_id"), F.col("qa_index")).alias("qa_index"),
                    qa_question(F.col("item")).alias("question"), qa_answers(F.col("item")).alias("answers"))


def _existing_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.qa_pairs(spark, sf_dir).select("file_type", F.col("qa_id").alias("qa_index"), "question", "answers")


def q_qa_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under `skip`, only file types without QA pairs are generated."""
    from slicewise.operators import qa
    files = testdata.file_types(spark, sf_dir).select(F.col("name").alias("file_type"))
    return qa.needs_generation(files, _existing_qa(spark, sf_dir), "skip")


def _policy(policy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from slicewise.operators import qa
        out = qa.apply_policy(_generated_qa(spark, sf_dir), _existing_qa(spark, sf_dir), policy)
        return out.select("file_type", "qa_order", "question",
                          F.array_join("answers", "\u001f").alias("answers_text"))
    return run


def q_score_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + A3: accepted judge scores (J7) and answer cosines (A1) of the sampled QAs, per file type."""
    from slicewise.operators import summary
    from slicewise.operators.judge import accept, parse_judgements
    from slicewise.operators.similarity import text_pair_cosine
    from slicewise.sources.model_replies import judge_replies
    acc = accept(parse_judgements(judge_replies(spark, sf_dir)), "qa_id")
    cos = text_pair_cosine(answer_pairs(spark, sf_dir), "qa_id", "std_text", "final_answer")
    from slicewise.operators import qa as qa_ops
    # lists are built over the sampled QA set of each file type (at most 8), as per experiment
    sampled = qa_ops.sample(testdata.qa_pairs(spark, sf_dir)).select("qa_id", F.col("file_type").alias("experiment_id"))
    m = (sampled.join(cos, "qa_id").join(acc.select("qa_id", F.col("score").cast("double").alias("llm_score")), "qa_id"))
    r = summary.per_experiment(m)
    return r.select(F.col("experiment_id").alias("file_type"), "n_questions",
                    _fmt_list("cosine_similaritys").alias("cosine_similaritys"),
                    F.array_join(F.transform("llm_evaluation_scores",
                                             lambda x: F.coalesce(F.format_string("%.0f", x), F.lit("null"))), ",")
                    .alias("llm_evaluation_scores"),
                    F.round("llm_score_ratio", 6).alias("llm_score_ratio"))


QUERIES.update({
    "retrieve_lexical_k8": q_retrieve_lexical_k8,
    "rerank_lexical_top4": q_rerank_lexical_top4,
    "rerank_fallback": q_rerank_fallback,
    "context_assembly": q_context_assembly,
    "prompt_render": q_prompt_render,
    "index_upsert": q_index_upsert,
    "index_versions": q_index_versions,
    "index_skip_existing": q_index_skip_existing,
    "qa_skip": q_qa_skip,
    "qa_append": _policy("append"),
    "qa_rebuild": _policy("rebuild"),
    "score_ratio": q_score_ratio,
})


# --------------------------------------------------------------------------- files, names, results
def q_text_files_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written as text files, one folder per type, and loaded by globs; one declared type has no file."""
    import uuid

    from slicewise.session import _MATERIALISED, checkpoint_dir
    from slicewise.sources import text_files
    base = f"{checkpoint_dir(spark).rstrip('/')}/slicewise-tables/{uuid.uuid4().hex}"
    testdata.corpus(spark, sf_dir).select("file_type", "text").write.partitionBy("file_type").text(base)
    _MATERIALISED.append(base)
    types = testdata.file_types(spark, sf_dir).select("name", F.concat(F.lit("file_type="), F.col("name"), F.lit("/*.txt")).alias("path"))
    docs, rejects = text_files.load_documents(spark, types, base)
    loaded = docs.groupBy("file_type").agg(F.sum("n_chars").alias("n_chars"))
    return (loaded.withColumn("reason", F.lit(None).cast("string"))
            .unionByName(rejects.select("file_type", F.lit(None).cast("long").alias("n_chars"), "reason")))


def q_file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every page's address and of every type's path."""
    from slicewise.functions.text import file_stem
    from slicewise.sources.tables import read_table
    urls = read_table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return (urls.unionByName(testdata.file_types(spark, sf_dir).select("path"))
            .select("path", file_stem(F.col("path")).alias("stem")).distinct())


def q_qa_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA sets named by the stem of their document, joined to the file types by path."""
    from slicewise.functions.text import file_stem
    qa = testdata.qa_pairs(spark, sf_dir).withColumnRenamed("file_type", "stem")
    types = testdata.file_types(spark, sf_dir).select(F.col("name").alias("file_type"), file_stem(F.col("path")).alias("stem"))
    return types.join(qa, "stem").groupBy("file_type").agg(F.count("*").cast("long").alias("n_pairs"), F.min("qa_id").alias("first_qa"))


def q_long_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type names longer than a collection name; names collide, keys and chunk ids do not."""
    from slicewise.functions.text import chunk_id
    from slicewise.operators.experiments import resolve
    from slicewise.session import cut_lineage
    from slicewise.sources.tables import SHIPPED_STRATEGIES, STRATEGY_SCHEMA, strategies_table
    long = lambda c: F.concat(F.repeat(F.lit("x"), F.lit(60)), c)
    corpus = testdata.corpus(spark, sf_dir).withColumn("file_type", long(F.col("file_type")))
    types = testdata.file_types(spark, sf_dir).withColumn("name", long(F.col("name")))
    experiments = testdata.experiments(spark, sf_dir).withColumn("file_type", long(F.col("file_type")))
    resolved, _ = resolve(experiments, types, strategies_table(spark), corpus, RUN_ID)
    pairs = cut_lineage(resolved.filter(F.col("method") != chunking.OUTSIDE).select(
        "collection", "collection_id", "file_type", "method", "chunk_size", "chunk_overlap", "separators").distinct())
    rows = [dict(zip(STRATEGY_SCHEMA.fieldNames(), r)) for r in SHIPPED_STRATEGIES]
    chunks = chunking.chunk_pairs(corpus.select("doc_id", "file_type", "text").join(pairs, "file_type"), rows)
    ids = chunks.select("collection", "collection_id", chunk_id(F.col("collection_id"), F.col("doc_id"), F.col("chunk_index")).alias("id"))
    return ids.groupBy("collection", "collection_id").agg(F.count("*").cast("long").alias("n_chunks"), F.min("id").alias("first_id"))


def q_union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two kinds, whose columns differ, in one table."""
    from slicewise.operators.summary import union_results
    cosine = q_answer_cosine(spark, sf_dir).withColumn("kind", F.lit("cosine"))
    overlap = q_token_overlap(spark, sf_dir).select("qa_id", "f1", F.lit("overlap").alias("kind"))
    return union_results([cosine, overlap])


QUERIES.update({
    "text_files_load": q_text_files_load,
    "file_stems": q_file_stems,
    "qa_by_stem": q_qa_by_stem,
    "long_type_names": q_long_type_names,
    "union_results": q_union_results,
})
