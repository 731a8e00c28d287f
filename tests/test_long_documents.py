"""C1 / C2 by fragments: the rules in plain Python, whatever the fragments."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import rules
from slicewise.operators import chunking, long_documents

EDGE = ["", None, "   ", "\n\n\n", "\nabc\n", "a\n\n\nb", "　x　\n y ", "\U0001F600" * 30 + "\n" + "b" * 300, "x" * 900,
        "a b " * 400, "中文" * 300, "one line\nand one\n\na paragraph\n" * 40, ("w" * 30 + "\n\n") * 50, "p " * 300 + "\n\n" + "q\n" * 200]


@pytest.fixture()
def short_fragments(monkeypatch):
    monkeypatch.setattr(long_documents, "MIN_FRAGMENTS_PER_HEAD", 1)


def _run(spark, texts, method, size, overlap, seps=None, chars=64):
    df = spark.createDataFrame([(i, t, size, overlap, "kept") for i, t in enumerate(texts)],
                               "doc_id long, text string, chunk_size int, chunk_overlap int, a string")
    out = {}
    for r in long_documents.split_long_text(df, method, seps, fragment_chars=chars).collect():
        assert r.a == "kept"
        out.setdefault(r.doc_id, []).append((r.chunk_index, r.chunk_text))
    assert all(sorted(k for k, _ in v) == list(range(len(v))) for v in out.values())
    return [[c for _, c in sorted(out.get(i, []))] for i in range(len(texts))]


def test_equals_the_rules(spark, short_fragments):
    r = random.Random(3)
    texts = EDGE + ["".join(r.choice(["a", "b", " ", "c", "\n", "\n\n\n", "xyz ", "　"]) if r.random() < .9 else "w" * r.randint(1, 150)
                            for _ in range(r.randint(1, 400))) for _ in range(40)]
    plain = [t or "" for t in texts]
    for size, ov in ((60, 20), (7, 7)):
        assert _run(spark, texts, chunking.LINE_MERGE, size, ov) == [rules.line_merge(t, size, ov) for t in plain]
        assert _run(spark, texts, chunking.RECURSIVE, size, ov) == [rules.recursive(t, size, ov) for t in plain]
    seps = [". ", "xyz", " "]
    assert _run(spark, texts, chunking.RECURSIVE, 25, 5, seps) == [rules.recursive(t, 25, 5, seps) for t in plain]


def test_fragments_tile_the_text():
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choice(["ab", " ", "\n", "\n\n", "z" * 40]) for _ in range(r.randint(0, 200)))
        cut = list(long_documents.fragments(text, ["\n\n", "\n", " ", ""], 30))
        assert "".join(text[a:b] for a, b, *_ in cut) == text and all(b - a <= 30 for a, b, *_ in cut)


def test_leaving_is_the_end_of_the_walk():
    r = np.random.RandomState(5)
    for n in (1, 2, 50, 300):
        nxt = np.array([min(n + 3, j + r.randint(1, 6)) for j in range(n)])
        for j in range(n):
            at = j
            while at < n:
                at = nxt[at]
            assert long_documents.leaving(nxt, n)[j] == at


def test_empty_tables_repeated_rows_and_other_methods(spark):
    schema = "doc_id long, text string, chunk_size int, chunk_overlap int"
    assert long_documents.split_long_text(spark.createDataFrame([], schema), chunking.RECURSIVE).count() == 0
    twice = spark.createDataFrame([(1, "a b c\n" * 50, 30, 5)] * 2 + [(None, "x", 30, None)], schema)
    got = long_documents.split_long_text(twice, chunking.LINE_MERGE)
    assert got.count() == 2 * len(rules.line_merge("a b c\n" * 50, 30, 5))
    with pytest.raises(ValueError):
        long_documents.split_long_text(twice, "own method")


def test_one_long_document_uses_several_tasks(spark):
    """Fragments of one document are spread, and the chunks are those of the whole text."""
    text = "".join(f"line {i} with a few words{'. ' * (i % 5)}\n" + ("\n" if i % 7 == 0 else "") for i in range(120_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("chunk_size", F.lit(1000)).withColumn("chunk_overlap", F.lit(200))
    for method, rule in ((chunking.LINE_MERGE, rules.line_merge), (chunking.RECURSIVE, rules.recursive)):
        got = long_documents.split_long_text(df, method, fragment_chars=100_000)
        want = rule(text, 1000, 200)
        assert [r.chunk_text for r in got.orderBy("chunk_index").collect()] == want


def test_any_number_of_separators(spark):
    seps = [f"<{i}>" for i in range(35)]
    text = "".join(f"{'x' * 9}{s}" for s in seps) * 2
    df = spark.createDataFrame([(1, text, 12, 3)], "doc_id long, text string, chunk_size int, chunk_overlap int")
    got = chunking.split_text(df, chunking.RECURSIVE, seps).orderBy("chunk_index").collect()
    assert [r.chunk_text for r in got] == rules.recursive(text, 12, 3, seps)
