"""A1 (TF-IDF cosine), A13 overlap, T4 rerank, J7 acceptance, A2 ratio on small frames."""

import math

from pyspark.sql import functions as F

from slicewise.operators import rerank, summary
from slicewise.operators.judge import accept
from slicewise.operators.similarity import text_pair_cosine


def _cos(a, b):
    """Reference statement of A1 for two texts (n = 2, smoothed idf, L2 norm)."""
    import re
    ta = re.findall(r"(?u)\b\w\w+\b", a.lower())
    tb = re.findall(r"(?u)\b\w\w+\b", b.lower())
    vocab = set(ta) | set(tb)
    if not vocab or not a.strip() or not b.strip():
        return 0.0
    idf = {t: math.log(3 / (1 + (t in ta) + (t in tb))) + 1 for t in vocab}
    va = {t: ta.count(t) * idf[t] for t in vocab}
    vb = {t: tb.count(t) * idf[t] for t in vocab}
    na, nb = math.sqrt(sum(v * v for v in va.values())), math.sqrt(sum(v * v for v in vb.values()))
    return 0.0 if na == 0 or nb == 0 else sum(va[t] * vb[t] for t in vocab) / (na * nb)


def test_cosine_cases(spark):
    pairs = [("the cat sat", "the cat sat"), ("alpha beta", "gamma delta"), ("", "x y"), ("a b c", "a b c"),
             ("中文句子", "中文"), ("one two two three", "two three four"),
             ("Hello, World! hello", "world hello")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k long, a string, b string")
    got = {r.k: r.cosine_similarity for r in text_pair_cosine(df, "k", "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        assert abs(got[i] - _cos(a, b)) < 1e-9, (a, b, got[i], _cos(a, b))
    assert abs(got[0] - 1.0) < 1e-12 and got[1] == 0.0 and got[2] == 0.0 and got[3] == 0.0


def test_rerank_top_n_and_fallback(spark):
    hits = spark.createDataFrame([
        ("q1", 1, "apples are red", "bananas yellow", 2), ("q1", 2, "apples are red", "apples are red fruit", 2),
        ("q1", 3, "apples are red", "red apples", 2), ("q2", 1, "", "anything", 2), ("q2", 2, "", "more", 2)],
        "query_id string, rank int, question string, chunk_text string, reranker_top_n int")
    out = {(r.query_id, r.rerank_rank): r.rank for r in rerank.rerank(hits).collect()}
    assert out[("q1", 1)] == 2 and len([k for k in out if k[0] == "q1"]) == 2
    assert out[("q2", 1)] == 1 and out[("q2", 2)] == 2          # empty question: unchanged, not cut


def test_accept_and_ratio(spark):
    parsed = spark.createDataFrame([(1, 0, False, None, None), (1, 1, True, 2, "ok"), (1, 2, True, 0, "x"),
                                    (2, 0, False, None, None), (3, 0, True, 1, "fine")],
                                   "qa_id long, attempt long, valid boolean, score long, justification string")
    acc = {r.qa_id: (r.accepted_attempt, r.score, r.resolved) for r in accept(parsed, "qa_id").collect()}
    assert acc == {1: (1, 2, True), 2: (None, None, False), 3: (0, 1, True)}
    m = spark.createDataFrame([("e", 1, 0.5, 2.0), ("e", 2, 0.1, None), ("e", 3, 0.2, 1.0)],
                              "experiment_id string, qa_id long, cosine_similarity double, llm_score double")
    r = summary.per_experiment(m).collect()[0]
    assert r.llm_score_ratio == 0.75 and r.cosine_similaritys == [0.5, 0.1, 0.2]
    assert list(r.llm_evaluation_scores) == [2.0, None, 1.0]
    try:
        summary.order_columns(m, ["experiment_id", "missing"])
        raise AssertionError("expected a missing-column error")
    except ValueError as e:
        assert "missing" in str(e)
