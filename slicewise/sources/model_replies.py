"""Model replies synthesised from the driver tables (no model is called).

Each builder is a plain string expression over table columns; the DuckDB
oracle builds the same strings. Reply shapes vary with a data-derived
`shape` number so that every parsing branch is exercised on every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.sources import testdata
from slicewise.sources.tables import read_table


def _esc_nl(c):
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def chat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, body): chat envelopes; system turns are not JSON, user turns have no choices."""
    conv = read_table(spark, sf_dir, "conversations")
    head = F.concat(F.lit('{"model": "chat-m", "usage": {"total_tokens": '), F.length("text").cast("string"), F.lit("}, "))
    content = F.concat(F.lit('"content": "'), _esc_nl(F.col("text")), F.lit('"'))
    reasoning = F.concat(F.lit(', "reasoning_content": "'), _esc_nl(F.col("text")), F.lit('"'))
    body = (F.when(F.col("role") == "system", F.col("text"))
            .when(F.col("role") == "user", F.concat(head, F.lit('"choices": []}')))
            .when(F.col("turn") % 4 == 1, F.concat(head, F.lit('"choices": [{"message": {'), content, F.lit("}}]}")))
            .otherwise(F.concat(head, F.lit('"choices": [{"message": {'), content, reasoning, F.lit("}}]}"))))
    return conv.select((testdata.turn_key(F.col("conv_id"), F.col("turn"))).alias("request_id"), body.alias("body"))


def embedding_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, body): embedding envelopes; label 3 is not JSON, label 7 has empty data."""
    emb = read_table(spark, sf_dir, "embeddings")
    nums = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", ")
    head = '{"model": "emb-m", "usage": {"total_tokens": 8}, '
    body = (F.when(F.col("label") == 3, F.lit("not json"))
            .when(F.col("label") == 7, F.lit(head + '"data": []}'))
            .otherwise(F.concat(F.lit(head + '"data": [{"embedding": ['), nums, F.lit("]}]}"))))
    return emb.select(F.col("vec_id").alias("chunk_id"), body.alias("body"))


def qa_generation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, reply): a QA-generation reply per conversation, in one of five shapes."""
    qa = testdata.qa_pairs(spark, sf_dir).withColumn("conv_id", (F.floor(F.col("qa_id") / testdata.TURN_KEY_STEP)).cast("long"))
    answers = F.concat(F.lit('"'), F.array_join("answers", '", "'), F.lit('"'))
    obj = F.concat(F.lit('{"question": "'), F.col("question"), F.lit('", "answers": ['), answers, F.lit("]}"))
    per = qa.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("qa_id", obj.alias("o"), F.col("question").alias("q")))).alias("objs"))
    objs = F.transform("objs", lambda s: s["o"])
    shape = F.col("conv_id") % 5
    reply = (F.when(shape == 0, F.concat(F.lit("```json\n["), F.array_join(objs, ",\n"),
                                         F.lit(', {"question": "incomplete"}]\n```')))
             .when(shape == 1, F.concat(F.lit("Here you go: "), F.array_join(objs, " and ")))
             .when(shape == 2, F.concat(F.lit("["), F.array_join(F.transform(objs, lambda o: F.replace(o, F.lit('"'), F.lit('\\"'))), ", "), F.lit("]")))
             .when(shape == 3, F.array_join(objs, " "))
             .otherwise(F.concat(F.lit("No pairs here: "), F.array_join(F.transform("objs", lambda s: s["q"]), ", "))))
    return per.select("conv_id", reply.alias("reply"))


def judge_replies(spark: SparkSession, sf_dir: str, attempts: int = 3) -> DataFrame:
    """(qa_id, attempt, reply): judge replies, several attempts per QA, in one of six shapes."""
    qa = testdata.qa_pairs(spark, sf_dir)
    tries = qa.select("qa_id", "question", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    s = (F.length("question") % 3).cast("string")
    j = F.col("question")
    shape = (F.col("qa_id") + F.col("attempt")) % 6
    reply = (F.when(shape == 0, F.concat(F.lit('{"score": '), s, F.lit(', "justification": "'), j, F.lit(" it\\'s fine\"}")))
             .when(shape == 1, F.concat(F.lit('{"score": '), s, F.lit('.0, "justification": "'), j, F.lit('"}')))
             .when(shape == 2, F.concat(F.lit('Verdict: {"score": '), s, F.lit('.0, "justification": "'), j, F.lit('" and more')))
             .when(shape == 3, F.concat(F.lit('{"score": "'), s, F.lit('", "justification": "'), j, F.lit('"}')))
             .when(shape == 4, F.concat(F.lit('{"score": true, "justification": "'), j, F.lit('"}')))
             .otherwise(F.concat(F.lit('{"score": '), (F.length("question") % 3 + 3).cast("string"),
                                 F.lit(', "justification": "'), j, F.lit('"}'))))
    return tries.select("qa_id", F.col("attempt").cast("long"), reply.alias("reply"))
