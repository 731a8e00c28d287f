"""U3 / U4 hooks of the batch: a user metric and a user answerer on sf0.001."""

import pandas as pd
from pyspark.sql import functions as F

from conftest import SMALL
from slicewise.plans import experiment_batch
from slicewise.sources import tables, testdata
from slicewise.sources.tables import strategies_table


def test_user_metric_and_answerer(spark):
    def answer_length(answers):                       # U3: one metric column per question
        return answers.select("query_id", F.length("final_answer").cast("double").alias("answer_chars"))

    def echo_answerer(ctx):                           # U4: replace the answering step
        return ctx.withColumn("final_answer", F.coalesce(F.col("guard_answer"), F.col("question")))

    b = experiment_batch.Batch(metrics=[answer_length], answerer=echo_answerer)
    out = experiment_batch.run(spark, testdata.corpus(spark, SMALL), testdata.file_types(spark, SMALL),
                               strategies_table(spark), testdata.experiments(spark, SMALL),
                               testdata.qa_pairs(spark, SMALL), b)
    rows = out.select("experiment_id", "answer_chars", "n_questions", "chunk_times_s").collect()
    asked = [r for r in rows if r.n_questions]          # file types with QA pairs at this scale
    assert asked and all(r.answer_chars is not None and r.answer_chars > 0 for r in asked)
    assert all(r.answer_chars is None for r in rows if not r.n_questions)
    assert all(r.chunk_times_s is not None and r.chunk_times_s > 0 for r in rows)
    # the echo answerer repeats the question, so every answer has the question's tokens
    m = b.frames["answers"].select((F.col("final_answer") == F.col("question")).alias("same")).collect()
    assert all(r.same for r in m)


def _small(spark):
    docs = spark.createDataFrame([(1, "t", "alpha beta\ngamma delta\n" * 20), (2, "t", "kappa lambda\nmu nu\n" * 20)],
                                 "doc_id long, file_type string, text string")
    types = spark.createDataFrame([("t", "books/t one.txt")], "name string, path string")
    qa = spark.createDataFrame([(i, "t one", f"what is {w} ?", [f"{w} it is"]) for i, w in enumerate(["alpha", "kappa", "nu"])],
                               "qa_id long, stem string, question string, answers array<string>")
    exps = [("plain", 0, "t", "simple_chunk_100_overlap_10", False, None, None, 3), ("re", 1, "t", "simple_chunk_100_overlap_10", True, "reverse", 2, 3),
            ("named", 2, "t", "simple_chunk_1", True, "no-such-model", 2, 3), ("outside", 3, "t", "embedding_chunk", False, None, None, 3)]
    cut = spark.createDataFrame([("t", "embedding_chunk", f"c{i}", x, i) for i, x in enumerate(["alpha beta", "kappa nu", "", "mu"])],
                                "file_type string, chunking_strategy string, id string, pageContent string, ord long")
    return docs, types, spark.createDataFrame(exps, tables.EXPERIMENT_SCHEMA), qa, cut


def test_rerank_hook_outside_chunks_and_qa_by_stem(spark):
    docs, types, exps, qa, cut = _small(spark)
    last_first = lambda hits: hits.filter("rank > 1").select("query_id", "rank", F.col("rank").cast("double").alias("score"))
    b = experiment_batch.Batch(prechunked=cut, rerankers={"reverse": last_first})
    rows = experiment_batch.run(spark, docs, types, strategies_table(spark), exps, qa, b).collect()
    assert len(rows) == 3 and all(r.n_questions == 3 for r in rows)
    assert [(r.experiment_id, r.reason) for r in b.frames["rejects"].collect()] == [("named", experiment_batch.REASON_UNKNOWN_RERANKER)]
    by = {r.chunking_strategy_name + r.reranker_model: r for r in rows}
    o = by["embedding_chunkNull"]
    assert (o.chunk_size, o.chunk_overlap, o.chunking_params, o.n_chunks, o.chunk_times_s) == (None, None, "{}", 3, 0.0)
    assert by["simple_chunk_100_overlap_10reverse"].reranker_nums == 2
    # the reranker listed ranks 2 and 3 only, highest rank first
    kept = b.frames["kept"].filter("rerank").orderBy("query_id", "rerank_rank").select("query_id", "rank").collect()
    assert [r["rank"] for r in kept] == [3, 2] * 3
    assert b.timings["total_s"] >= b.timings["chunk_and_index_s"] > 0 and rows[0].evaluation_times_s is not None
    assert b.release(spark) and not b.tables


def test_each_model_is_asked_once(spark):
    """Counted per row inside the model's function: one call per request and round, whatever reads the result later."""
    docs, types, exps, qa, _ = _small(spark)
    exps = exps.filter("experiment_id = 'plain'")
    asked = {name: spark.sparkContext.accumulator(0) for name in ("question", "judge", "answer")}

    def counting(name, kind="string"):
        counter = asked[name]

        @F.pandas_udf(kind)
        def call(s: pd.Series) -> pd.Series:
            counter.add(len(s))
            return s
        return call.asNondeterministic()

    def embedder(df, text_col):
        if text_col == "question":
            df = df.withColumn("question", counting("question")("question"))
        return experiment_batch.lexical_embedder(df, text_col)

    rounds = []

    def judge(requests):
        rounds.append(requests.count())
        assert {"prompt", "question", "context", "std_text", "final_answer"} <= set(requests.columns)
        good = F.lit('{"score": 2, "justification": "ok"}')
        reply = F.when(F.col("question").contains("alpha") | F.lit(len(rounds) > 1), good).otherwise(F.lit("no verdict"))
        return requests.withColumn("reply", counting("judge")(reply))

    answerer = lambda ctx: experiment_batch.extractive_answerer(ctx).withColumn("final_answer", counting("answer")("final_answer"))
    b = experiment_batch.Batch(embedder=embedder, judge=judge, answerer=answerer)
    row = experiment_batch.run(spark, docs, types, strategies_table(spark), exps, qa, b).collect()[0]
    assert list(row.llm_evaluation_scores) == [2.0, 2.0, 2.0] and rounds == [3, 2]
    assert {k: v.value for k, v in asked.items()} == {"question": 3, "judge": 5, "answer": 3}
    prompt = b.frames["judge_requests"].filter("question like '%kappa%'").first()["prompt"]
    assert "what is kappa ?" in prompt and "kappa it is" in prompt and "{" not in prompt.split("Reply as")[0]


def test_stored_collections_are_not_chunked_again(spark, tmp_path):
    docs, types, exps, qa, _ = _small(spark)
    exps = exps.filter("experiment_id = 'plain'")
    embedded = []

    def embedder(df, text_col):
        if text_col == "chunk_text":
            embedded.append(df)
        return experiment_batch.lexical_embedder(df, text_col)

    results = []
    for _ in range(2):
        b = experiment_batch.Batch(embedder=embedder, index_path=str(tmp_path / "index"))
        r = experiment_batch.run(spark, docs, types, strategies_table(spark), exps, qa, b)
        results.append(r.drop("chunk_times_s", "evaluation_times_s", "total_times_s").collect())
    assert results[0] == results[1] and results[0][0].n_chunks > 2
    assert [df.count() for df in embedded] == [results[0][0].n_chunks, 0]
    assert b.frames["skipped"].count() == 1


def test_batches_on_a_versioned_index(spark, tmp_path):
    from slicewise.sources import vector_index, versioned_index
    docs, types, exps, qa, _ = _small(spark)
    exps = exps.filter("experiment_id = 'plain'")
    results = []
    for store, path in [(vector_index, "plain"), (versioned_index, "versioned"), (versioned_index, "versioned")]:
        b = experiment_batch.Batch(index_path=str(tmp_path / path), index_store=store)
        r = experiment_batch.run(spark, docs, types, strategies_table(spark), exps, qa, b)
        results.append(r.drop("chunk_times_s", "evaluation_times_s", "total_times_s").collect())
    assert results[0] == results[1] == results[2] and results[0][0].n_chunks > 2
    assert b.frames["skipped"].count() == 1
