"""C1 / C2 against the plain-Python statement of the rules (rules.py), plus invariants."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import rules
from slicewise.operators import chunking

ALPHABET = st.sampled_from(list("ab c\n") + ["\n\n\n", "　", " ", "\U0001F600", "xyz ", "\t"])
TEXTS = st.lists(ALPHABET, min_size=0, max_size=120).map("".join)

EDGE = ["", "   ", "\n\n\n", "\nabc\n", "a\n\n\nb", "　x　\n y ", "\U0001F600" * 30 + "\n" + "b" * 300,
        "x" * 250, "a b " * 200, "中文" * 200, "line one\nline two\n\nparagraph two\n"]


def _run(spark, texts, method, size, overlap, seps=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = df.withColumn("chunk_size", F.lit(size)).withColumn("chunk_overlap", F.lit(overlap))
    out = {}
    for r in chunking.split_text(df, method, seps).collect():
        out.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_text))
    return [[c for _, c in sorted(out.get(i, []))] for i in range(len(texts))]


def test_line_merge_edges(spark):
    for size, ov in [(100, 10), (1000, 200), (5, 2), (1, 0)]:
        got = _run(spark, EDGE, chunking.LINE_MERGE, size, ov)
        assert got == [rules.line_merge(t, size, ov) for t in EDGE], (size, ov)


def test_recursive_edges(spark):
    for size, ov in [(150, 15), (50, 10), (8, 3)]:
        got = _run(spark, EDGE, chunking.RECURSIVE, size, ov)
        assert got == [rules.recursive(t, size, ov) for t in EDGE], (size, ov)


def test_recursive_custom_separators(spark):
    seps = [". ", " "]
    texts = ["one. two three. four five six. " * 20, "no separators here at all" * 10, "a. b"]
    got = _run(spark, texts, chunking.RECURSIVE, 40, 8, seps)
    assert got == [rules.recursive(t, 40, 8, seps) for t in texts]


@settings(max_examples=4, deadline=None)
@given(st.lists(TEXTS, min_size=20, max_size=40), st.sampled_from([(10, 3), (25, 5), (60, 0), (7, 7)]))
def test_property_both_splitters(spark, texts, params):
    size, ov = params
    assert _run(spark, texts, chunking.LINE_MERGE, size, ov) == [rules.line_merge(t, size, ov) for t in texts]
    assert _run(spark, texts, chunking.RECURSIVE, size, ov) == [rules.recursive(t, size, ov) for t in texts]


def test_invariants(spark):
    texts = ["word " * 300, "\n".join("line %d with some words" % i for i in range(200))]
    for got, t in zip(_run(spark, texts, chunking.RECURSIVE, 50, 10), texts):
        # with "" as last separator no chunk exceeds chunk_size
        assert all(len(c) <= 50 for c in got)
        assert all(c in t for c in got)
    one_line = "x" * 5741
    assert _run(spark, [one_line], chunking.LINE_MERGE, 100, 10) == [[one_line]]   # no newline -> one chunk


def test_plan_is_map_side(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").withColumn(
        "chunk_size", F.lit(10)).withColumn("chunk_overlap", F.lit(2))
    plan = chunking.split_text(df, chunking.RECURSIVE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_chunks_are_cut_once(spark):
    """No filter below the explode evaluates the chunk list (a `slice` of pieces) a second time."""
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").withColumn(
        "chunk_size", F.lit(10)).withColumn("chunk_overlap", F.lit(2))
    for method in (chunking.LINE_MERGE, chunking.RECURSIVE):
        plan = chunking.split_text(df, method)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("slice(") == 2, plan              # the stripped and the unstripped branch of one expression
        assert not any("slice(" in line for line in plan.splitlines() if "Filter " in line)


def test_time_grows_with_the_document(spark):
    """One long document: chunk texts are joined from pieces, not cut out of the whole text again and again."""
    import time
    for method in (chunking.LINE_MERGE, chunking.RECURSIVE):
        took = []
        for mb in (1, 2, 8):
            text = "some words in a line of text\n" * (mb * 35_000)
            df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn(
                "chunk_size", F.lit(100)).withColumn("chunk_overlap", F.lit(10))
            t0 = time.perf_counter()
            assert chunking.split_text(df, method).count() > mb * 10_000
            took.append(time.perf_counter() - t0)
        assert took[2] < 12 * max(took[1], 0.5), took       # 4 times the text; a quadratic cut takes 16 times


def test_many_separators_keep_the_plan_small():
    from pyspark.sql import SparkSession
    SparkSession.active()
    size = [len(str(chunking.recursive_leaves_sql("t", "n", [f"<{i}>" for i in range(n)])._jc.toString())) for n in (5, 10, 20)]
    assert size[2] < 5 * size[0]


def test_depth_beyond_sixteen(spark):
    seps = [f"<{i}>" for i in range(20)]
    text = "".join(f"{'x' * 9}{s}" for s in seps) * 3
    assert _run(spark, [text], chunking.RECURSIVE, 12, 3, seps) == [rules.recursive(text, 12, 3, seps)]


def test_empty_separator_list_and_custom_shapes(spark):
    chunking.register_splitter("by_first", lambda t, n, seps: F.expr(
        f"transform(split(`{t}`, '{(seps or ['-'])[0]}', -1), p -> named_struct('p', p, 'f', 2))"))
    rows = [{"method": chunking.RECURSIVE, "separators": []}, {"method": "by_first", "separators": ["a"]},
            {"method": "by_first", "separators": ["b"]}, {"method": "unheard_of", "separators": None}]
    text = "1a2b3 4"
    df = spark.createDataFrame([(i, r["method"], r["separators"], text, 1, 0) for i, r in enumerate(rows)],
                               "i int, method string, separators array<string>, text string, chunk_size int, chunk_overlap int")
    got = {}
    for r in chunking.chunk_pairs(df, rows).orderBy("chunk_index").collect():
        got.setdefault(r.i, []).append(r.chunk_text)
    assert got == {0: rules.recursive(text, 1, 0), 1: ["1", "2b3 4"], 2: ["1a2", "3 4"]}
