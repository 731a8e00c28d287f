"""A whole batch of experiments as one set of Spark jobs (the flagship).

resolve (J1) -> leave out collections that are indexed already (J5) -> chunk every
other (file type, strategy) pair once (C5), add chunks cut elsewhere (S3) -> embed
chunks (X7) and store them as the index (S8) -> sample questions per file type (T5)
and join them to their experiments (J8) -> nearest chunks per question (J2, T1)
-> rerank where asked, by the named method (T4) -> context and guards (A6, A5, P14)
-> answer (X5) -> cosine (A1) and judge in rounds (X6, J7, P11, P12) -> recall of the
context (A12), top-k vs original (A14) -> one summary row per experiment (A2, A3, A8).

Shuffle budget: chunking is map-side; the chunk index is written once, partitioned by
nothing but read by column; retrieval keeps max(k) rows per question and partition before its
shuffle. Everything after retrieval is bounded by (questions x k). Question vectors, hits,
answers and every round of judgements are materialised, so each model is asked once.

Model steps are hooks. The defaults are deterministic and local to Spark:
hashed term-frequency vectors, a lexical reranker, an extractive answerer (the top
context chunk) and a lexical judge that writes its verdict as a JSON reply, which then goes
through the same reply parser as a model's. Replace them with functions that
take and return DataFrames (for example `mapInPandas` over a model client).
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from types import ModuleType
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.functions.text import chunk_id, file_stem
from slicewise.operators import chunking, judge as judge_ops, qa as qa_ops, rerank as rerank_ops, summary
from slicewise.operators.experiments import resolve
from slicewise.operators.prompts import assemble_context, render, templates_table
from slicewise.operators.retrieval import LEXICAL_DIMS, LEXICAL_EMBEDDER, knn, unscorable, with_lexical_embedding
from slicewise.operators.similarity import chunk_document_cosine, joined_answers, text_pair_cosine, token_overlap
from slicewise.session import cut_lineage, release_tables
from slicewise.sources import prechunked, vector_index

# Recall threshold of A12 and the lexical judge's score bands (token recall).
RECALL_THRESHOLD = 0.5
JUDGE_BANDS = (0.5, 0.2)   # recall >= 0.5 -> 2, >= 0.2 -> 1, else 0

Embedder = Callable[[DataFrame, str], DataFrame]        # (df, text column) -> df + embedding
Answerer = Callable[[DataFrame], DataFrame]              # contexts -> + final_answer
Reranker = Callable[[DataFrame], DataFrame]              # hits -> (query_id, rank, score) of the hits it lists
Judge = Callable[[DataFrame], DataFrame]                 # requests (JudgeAs prompt, question, context, ...) -> + reply

REASON_UNKNOWN_RERANKER = "unknown reranker"
REASON_NO_PRECHUNKED = "no pre-chunked rows"
LEXICAL_RERANKER = "lexical"


def lexical_embedder(df: DataFrame, text_col: str) -> DataFrame:
    return with_lexical_embedding(df, text_col)


def extractive_answerer(ctx: DataFrame) -> DataFrame:
    """Default answer: the guard answer, else the top context chunk."""
    return ctx.withColumn("final_answer", F.coalesce(F.col("guard_answer"), F.element_at("context", 1)))


def lexical_judge(answers: DataFrame) -> DataFrame:
    """Default judge: token recall of the standard answer in the answer, written as a JSON reply."""
    recall = token_overlap(F.col("std_text"), F.col("final_answer"))["recall"]
    score = F.when(recall >= JUDGE_BANDS[0], 2).when(recall >= JUDGE_BANDS[1], 1).otherwise(0)
    reply = F.concat(F.lit('{"score": '), score.cast("string"), F.lit(', "justification": "token recall '),
                     F.format_string("%.3f", recall), F.lit('"}'))
    return answers.withColumn("reply", reply)


@dataclass
class Batch:
    run_id: str = "run0"
    seed: str = "seed0"
    qa_per_file: int = 8
    embedder: Embedder = lexical_embedder
    answerer: Answerer = extractive_answerer
    judge: Judge = lexical_judge
    judge_rounds: int = judge_ops.DEFAULT_MAX_ROUNDS
    # reranker by method name; an experiment that names another one is rejected
    rerankers: dict[str, Reranker] = field(default_factory=lambda: {LEXICAL_RERANKER: rerank_ops.lexical_scores})
    # chunks cut elsewhere, for `outside` strategies: (file_type, chunking_strategy, id, pageContent, ord)
    prechunked: DataFrame | None = None
    # C4: chunk every strategy once more by itself to time it (else one shared time is reported)
    time_strategies: bool = False
    # a stored index: its collections are used as they are, new ones are added to it
    index_path: str | None = None
    # how it is stored: vector_index, or versioned_index (an upsert rewrites nothing)
    index_store: ModuleType = vector_index
    embedder_name: str = LEXICAL_EMBEDDER
    # Extra metrics, each answers -> DataFrame(query_id, <one metric column>), averaged per experiment
    metrics: list = field(default_factory=list)
    frames: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)   # A15 / C4: wall seconds of the batch's actions
    tables: list = field(default_factory=list)    # materialised tables of this batch

    def keep(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df, owner=self.tables)

    def timed(self, name: str, df: DataFrame) -> DataFrame:
        t0 = time.perf_counter()
        out = self.keep(df)
        self.timings[name] = self.timings.get(name, 0.0) + time.perf_counter() - t0
        return out

    def release(self, spark: SparkSession) -> int:
        """Delete this batch's tables; call once its result is consumed."""
        return release_tables(spark, self.tables)


def run(spark: SparkSession, corpus: DataFrame, file_types: DataFrame, strategies: DataFrame,
        experiments: DataFrame, qa_pairs: DataFrame, batch: Batch | None = None,
        checkpoint_index: bool = True, stop_after: str | None = None) -> DataFrame | None:
    """Summary rows of every resolvable experiment; intermediate frames land in batch.frames.

    stop_after="retrieval" returns None once hits, reranked hits, contexts and
    prompts are in batch.frames (for callers that need only those).
    """
    b = batch or Batch()
    began = time.perf_counter()
    resolved, rejects = resolve(experiments, file_types, strategies, corpus, b.run_id)
    # configuration-sized, read by every later step: materialise once
    resolved = b.keep(resolved)
    method = F.when(F.col("reranker_method") == "", LEXICAL_RERANKER).otherwise(F.col("reranker_method"))
    resolved = resolved.withColumn("reranker_method", method)
    outside = F.col("method") == chunking.OUTSIDE
    reason = F.when(F.col("rerank") & ~F.col("reranker_method").isin(list(b.rerankers)), F.lit(REASON_UNKNOWN_RERANKER))
    if b.prechunked is None:
        reason = reason.when(outside, F.lit(REASON_NO_PRECHUNKED))
    resolved = resolved.withColumn("reason", reason)
    rejects = rejects.unionByName(resolved.filter(F.col("reason").isNotNull()).select(*rejects.columns))
    resolved = b.keep(resolved.filter(F.col("reason").isNull()).drop("reason"))
    b.frames["rejects"] = rejects

    # Collections that the stored index holds are neither chunked nor embedded again
    pairs = resolved.select("collection", "collection_id", "file_type", "chunking_strategy", "method", "chunk_size",
                            "chunk_overlap", "separators").distinct()
    old = b.index_store.stored(spark, b.index_path) if b.index_path else None
    if old is not None:
        old = old.withColumnRenamed("collection", "collection_id")
        present = b.keep(old.select("collection_id").distinct())
        pairs, skipped = pairs.join(present, "collection_id", "left_anti"), pairs.join(present, "collection_id", "left_semi")
        b.frames["skipped"] = skipped
    pairs = b.keep(pairs)

    # Every other (file type, strategy) pair once
    docs = corpus.select("doc_id", "file_type", "text")
    strategy_rows = [r.asDict() for r in strategies.select("method", "separators").distinct().collect()]
    # The built-in vectors come with the chunks, from one tokenisation of a document for all its strategies
    lexical = b.embedder is lexical_embedder
    cols = ["collection", "collection_id", "file_type", "chunking_strategy", "doc_id", "chunk_index", "chunk_text",
            *(["embedding"] if lexical else [])]
    chunks = (chunking.chunk_pairs(docs.join(pairs, "file_type"), strategy_rows, dims=LEXICAL_DIMS if lexical else None)
              .withColumn("chunk_index", F.col("chunk_index").cast("long")).select(*cols))
    if b.time_strategies:
        for name in [r[0] for r in pairs.filter(~outside).select("chunking_strategy").distinct().collect()]:
            t0 = time.perf_counter()
            mine = pairs.filter(F.col("chunking_strategy") == name)
            chunking.chunk_pairs(docs.join(mine, "file_type"), strategy_rows).write.format("noop").mode("overwrite").save()
            b.timings[f"chunk_s:{name}"] = time.perf_counter() - t0
    if b.prechunked is not None:
        rows = b.prechunked.join(pairs.filter(outside).select("collection", "collection_id", "file_type", "chunking_strategy"),
                                 ["file_type", "chunking_strategy"])
        cut = prechunked.ingest(rows, "id", collection_col="collection_id").withColumnRenamed("collection", "collection_id")
        cut = cut.join(pairs.select("collection", "collection_id", "file_type", "chunking_strategy"), "collection_id")
        cut = b.embedder(cut, "chunk_text") if lexical else cut
        chunks = chunks.unionByName(cut.withColumn("doc_id", F.lit(None).cast("long")).select(*cols))
    chunks = chunks.withColumn("chunk_id", chunk_id(F.col("collection_id"), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("chunk_index")))
    index = chunks if lexical else b.embedder(chunks, "chunk_text")
    if checkpoint_index:
        # C4: one pass chunks (and embeds) every strategy of the batch; its wall time is shared
        index = b.timed("chunk_and_index_s", index)      # written once, read by retrieval, hit text and metrics
    dims = LEXICAL_DIMS if b.embedder is lexical_embedder else None
    b.frames["unscorable"] = unscorable(index, dims=dims).select("collection", "chunk_id", "reason")
    if b.index_path:
        new = index.withColumn("version", F.lit(0)).drop("collection").withColumnRenamed("collection_id", "collection")
        b.index_store.upsert(spark, b.index_path, new)
        names = resolved.select("collection", "collection_id", "file_type", "chunking_strategy").distinct()
        index = (b.index_store.stored(spark, b.index_path).withColumnRenamed("collection", "collection_id")
                 .drop("file_type", "chunking_strategy", "version").join(names, "collection_id"))
    b.frames["index"] = index

    # T5 + J8: sampled questions of each file type, joined to that type's experiments
    if "file_type" not in qa_pairs.columns:          # QA files are tied to a type by the stem of its document
        stems = file_types.select(F.col("name").alias("file_type"), file_stem(F.col("path")).alias("stem"))
        qa_pairs = qa_pairs.join(stems, "stem").drop("stem")
    sampled = qa_ops.sample(qa_pairs, b.qa_per_file, b.seed)
    exp_cols = resolved.select("experiment_id", "file_type", "collection", "collection_id", "retrieval_n_results", "rerank",
                               "reranker_method", "reranker_top_n")
    questions = b.keep(
        sampled.join(exp_cols, "file_type")
        .withColumn("query_id", F.concat_ws("|", "experiment_id", F.col("qa_id").cast("string")))
        .withColumn("std_text", joined_answers(F.col("answers"))))
    qvec = b.embedder(questions.select("query_id", "collection_id", "retrieval_n_results", "question"), "question")
    qvec = b.keep(qvec.withColumnRenamed("embedding", "query_vector"))
    max_k = resolved.agg(F.max("retrieval_n_results")).first()[0] or 0     # settings: one number

    # J2 + T1: top-k per question inside its collection
    # hits are bounded by questions x k: materialise them so the many readers below do not re-run the search
    search = knn(qvec, index, "retrieval_n_results", order_tiebreak="chunk_id", join_keys=("collection_id",), dims=dims, max_k=max_k)
    b.frames["search"] = search
    hit_keys = b.keep(search.select("query_id", "collection_id", "chunk_id", "rank", "distance"))
    # only chunks that were hit are joined back to their texts
    texts = (index.select("collection", "collection_id", "chunk_id", "doc_id", "chunk_text")
             .join(hit_keys.select("collection_id", "chunk_id").distinct(), ["collection_id", "chunk_id"], "left_semi"))
    hits = texts.join(hit_keys, ["collection_id", "chunk_id"])
    hits = b.keep(hits.join(questions.select("query_id", "question", "rerank", "reranker_method", "reranker_top_n"), "query_id"))
    b.frames["hits"] = hits

    # T4: rerank where asked, keep everything otherwise
    asked = hits.filter(F.col("rerank"))
    scores = None
    for name, scorer in b.rerankers.items():
        got = scorer(asked.filter(F.col("reranker_method") == name)).select("query_id", "rank", "score")
        scores = got if scores is None else scores.unionByName(got)
    rr = rerank_ops.rerank(asked, "reranker_top_n", scores=b.keep(scores))
    plain = hits.filter(~F.col("rerank")).withColumn("rerank_rank", F.col("rank")).withColumn(
        "score", F.lit(None).cast("double"))
    kept = rr.unionByName(plain)
    b.frames["kept"] = kept
    b.frames["questions"] = questions

    # A6 + A5 + P14, then X5
    ctx = assemble_context(questions.select("query_id", "experiment_id", "qa_id", "question", "std_text", "rerank"),
                           hits, kept, ["query_id"], "rerank_rank")
    b.frames["context"] = ctx
    prompts = render(ctx, templates_table(spark), "RAGAnswer",
                     {"question": ("question", False), "document": ("context", True)})
    b.frames["prompts"] = prompts
    if stop_after == "retrieval":
        return None
    # answers are bounded by the questions and read by every metric below: materialise once
    answers = b.timed("answer_s", b.answerer(prompts))
    b.frames["answers"] = answers

    # A1 + X6/P11/P12
    cos = text_pair_cosine(answers.select("query_id", "std_text", "final_answer"), "query_id",
                           "std_text", "final_answer")
    requests = render(answers.select("query_id", "question", "context", "std_text", "final_answer"), templates_table(spark), "JudgeAs",
                      {"question": ("question", False), "document": ("context", True), "std": ("std_text", False),
                       "judge": ("final_answer", False)})
    b.frames["judge_requests"] = requests
    t0 = time.perf_counter()
    judged = b.keep(judge_ops.run_rounds(
        b.keep(requests), lambda todo, attempt: b.judge(todo).select("query_id", F.lit(attempt).cast("long").alias("attempt"), "reply"),
        "query_id", b.judge_rounds, b.tables))
    b.timings["evaluate_s"] = time.perf_counter() - t0
    b.frames["judged"] = judged
    covered = token_overlap(F.col("std_text"), F.array_join("context", "\n"))["recall"] >= RECALL_THRESHOLD
    metrics = (answers.select("query_id", "experiment_id", "qa_id", covered.alias("covered"),
                              F.length("prompt").alias("prompt_chars"))
               .join(cos, "query_id").join(judged.select("query_id", F.col("score").cast("double").alias("llm_score")),
                                           "query_id"))
    b.frames["metrics"] = metrics

    # Retrieved chunks against their documents (only documents that were hit are tokenised)
    hit_chunks = hits.select("query_id", "rank", "doc_id", "chunk_text")
    hit_docs = corpus.select("doc_id", "text").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    topk = (chunk_document_cosine(hit_chunks, hit_docs, ["query_id", "rank", "doc_id"])
            .join(questions.select("query_id", "experiment_id"), "query_id")
            .groupBy("experiment_id").agg(F.avg("cosine_similarity").alias("topk_vs_original")))

    # A2 + A3 + A8
    rolled = summary.per_experiment(metrics.select("experiment_id", "qa_id", "cosine_similarity", "llm_score"))
    extra = metrics.groupBy("experiment_id").agg(F.avg(F.col("covered").cast("double")).alias("qa_recall"))
    for fn in b.metrics:                     # U3: user metrics joined on the question key
        m = fn(answers)
        col = [c for c in m.columns if c != "query_id"][0]
        per = (m.join(answers.select("query_id", "experiment_id"), "query_id")
               .groupBy("experiment_id").agg(F.avg(col).alias(col)))
        extra = extra.join(per, "experiment_id", "left")
    n_chunks = index.groupBy("collection_id").agg(F.count("*").cast("long").alias("n_chunks"))
    out = summary.assemble(resolved, rolled)
    out = (out.join(extra, "experiment_id", "left").join(topk, "experiment_id", "left")
              .join(resolved.select("experiment_id", "collection_id"), "experiment_id")
              .join(n_chunks, "collection_id", "left").drop("collection_id")
              .withColumn("embedder", F.lit(b.embedder_name)))
    if "chunk_and_index_s" in b.timings:
        # chunks cut elsewhere report no time
        shared = F.lit(round(b.timings["chunk_and_index_s"], 3))
        for name, took in b.timings.items():
            if name.startswith("chunk_s:"):
                shared = F.when(F.col("chunking_strategy_name") == name[8:], F.lit(round(took, 3))).otherwise(shared)
        out = out.withColumn("chunk_times_s", F.when(F.col("chunking_method") == chunking.OUTSIDE, F.lit(0.0)).otherwise(shared))
    b.timings["total_s"] = time.perf_counter() - began      # A15: until the summary is defined; its own action comes after
    out = (out.withColumn("evaluation_times_s", F.lit(round(b.timings["evaluate_s"], 3)))
              .withColumn("total_times_s", F.lit(round(b.timings["total_s"], 3))))
    return summary.order_columns(out)        # A9: configured columns first, extras after
