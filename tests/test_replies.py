"""P7-P12 on hand-made replies (modelled on the reference's documented cases)."""

from pyspark.sql import functions as F

from slicewise.functions.replies import chat_envelope, judgement, qa_answers, qa_items, qa_question


def _qa(spark, reply):
    df = spark.createDataFrame([(reply,)], "reply string").select(qa_items(F.col("reply")).alias("x"))
    df = df.select("x.branch", F.explode_outer("x.items").alias("i"))
    rows = df.select("branch", qa_question(F.col("i")).alias("q"), qa_answers(F.col("i")).alias("a")).collect()
    return rows[0].branch if rows else None, [(r.q, r.a) for r in rows if r.q is not None]


def test_qa_fenced_list(spark):
    reply = '```json\n[{"question": "What is AI?", "answers": ["A", "B"]}, {"question": "ML?", "answers": ["C"]}]\n```'
    branch, pairs = _qa(spark, reply)
    assert branch == "json" and pairs == [("What is AI?", ["A", "B"]), ("ML?", ["C"])]


def test_qa_single_object_and_bad_items(spark):
    assert _qa(spark, 'x {"question": "Q", "answers": ["a"]} y')[1] == [("Q", ["a"])]
    reply = '[{"question": "Q1", "answers": "not a list"}, {"question": "Q2"}, {"question": "Q3", "answers": []}]'
    assert _qa(spark, reply)[1] == [("Q3", [])]


def test_qa_side_by_side_goes_to_fallback(spark):
    reply = '{"question": "Q1", "answers": ["a"]} {"question": "Q2", "answers": ["b"]}'
    branch, pairs = _qa(spark, reply)
    assert branch == "fallback" and pairs == [("Q1", ["a"]), ("Q2", ["b"])]


def test_qa_truncated_list_keeps_complete_objects(spark):
    reply = '[{"question": "Q1", "answers": ["a"]}, {"question": "Q2", "answers": ["b'
    branch, pairs = _qa(spark, reply)
    assert branch == "fallback" and pairs == [("Q1", ["a"])]


def test_qa_no_json(spark):
    assert _qa(spark, "nothing here")[1] == []


def _judge(spark, reply):
    r = spark.createDataFrame([(reply,)], "reply string").select(judgement(F.col("reply")).alias("j")).collect()[0].j
    return r.valid, r.score


def test_judge_types(spark):
    assert _judge(spark, '{"score": 1, "justification": "ok"}') == (True, 1)
    assert _judge(spark, '{"score": 1.0, "justification": "ok"}') == (False, None)      # float in JSON
    assert _judge(spark, 'x {"score": 1.0, "justification": "ok" broken') == (True, 1)  # regex path
    assert _judge(spark, '{"score": "1", "justification": "ok"}') == (False, None)
    assert _judge(spark, '{"score": true, "justification": "ok"}') == (True, 1)         # bool is an int
    assert _judge(spark, '{"score": 3, "justification": "ok"}') == (False, None)
    assert _judge(spark, '{"score": 2}') == (False, None)
    assert _judge(spark, "Sure! {\"score\": 2, \"justification\": \"it\\'s fine\"} thanks") == (True, 2)


def test_chat_envelope(spark):
    body = '{"model": "m", "usage": {"total_tokens": 5}, "choices": [{"message": {"content": "hi"}}]}'
    rows = spark.createDataFrame([(body,), ("not json",), ('{"choices": []}',)], "b string").select(
        chat_envelope(F.col("b")).alias("e")).collect()
    assert (rows[0].e.valid, rows[0].e.tokens_used, rows[0].e.ans_content, rows[0].e.thinking_content) == (True, 5, "hi", None)
    assert rows[1].e.valid is False and rows[2].e.ans_content is None


def test_duplicate_keys_keep_the_last_value(spark):
    # Python's json keeps the last of repeated keys; the session allows duplicates with the same rule
    reply = '{"question": "old", "question": "new", "answers": ["a"]}'
    assert _qa(spark, reply)[1] == [("new", ["a"])]
    assert _judge(spark, '{"score": 0, "score": 2, "justification": "x"}') == (True, 2)
