"""The walk's own leaves equal the native ones, and rows go to Arrow many at a time."""

import random

import pandas as pd
from pyspark.sql import functions as F

from slicewise.operators import chunking, long_documents, merge_walk

TEXTS = ["", "\n", "\n\n\n", " ", "a", "a\nb", "\n\na b\n\n\nccc dddddddddd\n", "é　x \U0001F600\n" * 3, "long" * 9, " lead\ntrail ", "a\\Eb--c"]


def _texts():
    r = random.Random(5)
    return TEXTS + ["".join(r.choice("ab \n\n -x") for _ in range(r.randrange(1, 90))) for _ in range(60)]


def test_codes_equal_the_native_leaves(spark):
    df = spark.createDataFrame([(i, t, n) for i, t in enumerate(_texts()) for n in (1, 4, 15)], "i int, text string, chunk_size int")
    shapes = [(chunking.LINE_MERGE, None), (chunking.RECURSIVE, None), (chunking.RECURSIVE, ["--", "\n", " "]), (chunking.RECURSIVE, ["", " "])]
    for method, seps in shapes:
        native = df.withColumn("leaves", chunking.leaves_for(method, seps, "text", "chunk_size")).select(
            "text", "chunk_size", F.transform("leaves", lambda x: F.length(x["p"]).cast("long") * 4096 + x["f"]).alias("codes")).collect()
        for r in native:
            mine = merge_walk.leaf_codes(r.text, chunking.walk_separators(method, seps), r.chunk_size)
            ours, theirs = ([merge_walk.walk_document(c, r.chunk_size, o) for o in (0, 3)] for c in (mine, r.codes))
            assert [c >> 12 for c in mine] == [c >> 12 for c in r.codes] and ours == theirs, (method, seps, r)


def test_split_text_sends_no_struct_per_piece_to_the_walk(spark):
    df = spark.createDataFrame([(1, "a b\nc", 2, 0)], "doc_id long, text string, chunk_size int, chunk_overlap int")
    for method in (chunking.LINE_MERGE, chunking.RECURSIVE):
        assert "split(" not in chunking.split_text(df, method)._jdf.queryExecution().optimizedPlan().toString()


def test_null_texts_have_no_chunks(spark):
    rows = [{"method": chunking.LINE_MERGE, "separators": None}, {"method": chunking.RECURSIVE, "separators": None}]
    df = spark.createDataFrame([(m["method"], None, t, 5, 1) for m in rows for t in (None, "", " \n ", "ab")],
                               "method string, separators array<string>, text string, chunk_size int, chunk_overlap int")
    assert sorted((r.method, r.chunk_text) for r in chunking.chunk_pairs(df, rows).collect()) == sorted((m["method"], "ab") for m in rows)


def test_fragments_come_many_to_a_frame():
    batch = pd.DataFrame({"_row": [1, 2, 3], "t": ["one\ntwo\nthree\n" * 40] * 3, "s": [10] * 3, "o": [2] * 3})
    frames = list(long_documents._cut(["\n"], 160, "t", "s", "o")(iter([batch])))
    assert len(frames) == 1 and len(frames[0]) > 9                     # before: a frame per 16 fragments of one text
    assert len(list(long_documents._find_leaves(["\n"], True)(iter(frames)))) == 1      # before: a frame per fragment
    heads = pd.DataFrame({"_row": [1, 1, 2], "_frag": [0, 1, 0]})
    assert [len(d) for d in long_documents._documents(iter([heads[:1], heads[1:]]))] == [2, 1]
