"""S1, S4/S5, S6, S7, S8/S9, U1, X4 on small hand-made files and frames."""

import csv
import datetime
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import rules
from slicewise.operators import chunking, qa
from slicewise.operators.prompts import templates_table
from slicewise.operators.summary import write_csv
from slicewise.sources import qa_text, text_files, vector_index

CHAPTER = "\n".join(f"Chapter line {i} " + "words " * (i % 30) for i in range(120)) + "\n\nEpilogue."
RULES = "1. Tickets are sold online.\n\n2. Refunds within 7 days.\n3. Children under 6 ride free.\n"
SHORT = "A single short line."
FLAT = "longflattext" * 480


def _files(tmp):
    for name, text in [("chapter_book.txt", CHAPTER), ("rules_simple.txt", RULES), ("plain_short.txt", SHORT),
                       ("santi_1.txt", FLAT)]:
        with open(os.path.join(tmp, name), "w", encoding="utf-8") as f:
            f.write(text)


def test_load_documents_and_rejects(spark):
    tmp = tempfile.mkdtemp(prefix="slicewise-files-")
    _files(tmp)
    ft = spark.createDataFrame([("chapter_text", "chapter_book.txt"), ("rules_simple", "rules_simple.txt"),
                                ("short_plain_text", "plain_short.txt"), ("long_flat_book", "santi_1.txt"),
                                ("rules_complex", "rules_complex.txt")], "name string, path string")
    docs, rejects = text_files.load_documents(spark, ft, tmp)
    got = {r.file_type: r.text for r in docs.collect()}
    assert got == {"chapter_text": CHAPTER, "rules_simple": RULES, "short_plain_text": SHORT, "long_flat_book": FLAT}
    assert [(r.file_type, r.reason) for r in rejects.collect()] == [("rules_complex", text_files.REASON_MISSING_FILE)]
    chunks = chunking.split_text(docs.withColumn("chunk_size", F.lit(100)).withColumn("chunk_overlap", F.lit(10)),
                                 chunking.LINE_MERGE)
    flat = [r.chunk_text for r in chunks.filter(F.col("file_type") == "long_flat_book").collect()]
    assert flat == rules.line_merge(FLAT, 100, 10) == [FLAT]       # no newline -> one chunk


def test_load_documents_paths(spark):
    """Relative folders, names with blanks, globs, and a type that is defined twice."""
    tmp = tempfile.mkdtemp(prefix="slicewise-files-")
    os.makedirs(f"{tmp}/my data")
    _files(f"{tmp}/my data")
    os.rename(f"{tmp}/my data/plain_short.txt", f"{tmp}/my data/plain + short.txt")
    relative = os.path.relpath(f"{tmp}/my data", spark.sparkContext._jvm.System.getProperty("user.dir"))
    ft = spark.createDataFrame([("short", "plain + short.txt", 0), ("short", "santi_1.txt", 1), ("both", "[cr]*.txt", 2), ("none", "x*.txt", 3)],
                               "name string, path string, position int")
    for base in (relative, f"{tmp}/my data", f"file://{tmp}/my data"):
        docs, rejects = text_files.load_documents(spark, ft, base)
        assert sorted((r.file_type, r.text) for r in docs.collect()) == sorted([("short", SHORT), ("both", CHAPTER), ("both", RULES)])
        assert [r.file_type for r in rejects.collect()] == ["none"]


def test_unreadable_index_keeps_its_rows(spark):
    path = tempfile.mkdtemp(prefix="slicewise-index-") + "/index"
    schema = "collection string, chunk_id string, doc_id long, chunk_index int, chunk_text string, embedding array<double>, version int"
    vector_index.upsert(spark, path, spark.createDataFrame([("c", "a", 1, 0, "t", [1.0], 0)], schema))
    part = glob.glob(path + "/collection=c/*.parquet")[0]
    with open(part, "rb") as f:
        good = f.read()
    with open(part, "wb") as f:
        f.write(b"not parquet")
    crc = part.replace("part-", ".part-") + ".crc"
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(Exception):
        vector_index.upsert(spark, path, spark.createDataFrame([("c", "b", 1, 1, "u", [2.0], 1)], schema))
    assert glob.glob(path + "/collection=c/*.parquet") == [part]
    with open(part, "wb") as f:
        f.write(good)
    assert [r.chunk_id for r in spark.read.parquet(path).collect()] == ["a"]


def test_rows_of_one_version_never_mix(spark):
    new = spark.createDataFrame([("c", "a", None, [1.0], 1), ("c", "a", "t", [2.0], 1)],
                                "collection string, chunk_id string, chunk_text string, embedding array<double>, version int")
    merged, _ = vector_index.upsert_frames(new.limit(0), new)
    assert [(r.chunk_text, r.embedding) for r in merged.collect()] in ([(None, [1.0])], [("t", [2.0])])


def test_dense_index_of_one_hot_collection(spark):
    """One collection, sparse and skewed order values, duplicates of none: positions are dense and in order."""
    from slicewise.functions.indexing import dense_index
    orders = [i * i * 1_000_003 + (1 << 40) * (i % 3) for i in range(3000)]
    df = spark.createDataFrame([("hot", x) for x in orders] + [("cold", x) for x in orders[:7]], "c string, o long").repartition(5)
    got = {(r.c, r.o): r["index"] for r in dense_index(df, ["c"], "o", buckets=16).collect()}
    for name, values in (("hot", orders), ("cold", orders[:7])):
        assert [got[name, x] for x in sorted(values)] == list(range(len(values)))
    assert dense_index(df.limit(0), ["c"], "o").count() == 0


def test_chunk_texts_for_inspection(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", 1, 0, "a"), ("c2", 1, 0, "b")], "collection string, doc_id long, chunk_index int, chunk_text string")
    vector_index.write_chunks(chunks, str(tmp_path / "x"))
    vector_index.write_chunks(chunks.filter("collection = 'c2'").withColumn("chunk_text", F.lit("new")), str(tmp_path / "x"))
    assert {(r.collection, r.chunk_text) for r in spark.read.parquet(str(tmp_path / "x")).collect()} == {("c1", "a"), ("c2", "new")}


def test_qa_jobs_stems(spark):
    tmp = tempfile.mkdtemp(prefix="slicewise-files-")
    _files(tmp)
    jobs = {r.stem: r.output_path for r in text_files.qa_jobs(spark, tmp + "/*.txt", "/out/qa").collect()}
    assert jobs["rules_simple"] == "/out/qa/rules_simple_qa_pairs.txt" and len(jobs) == 4


def test_qa_text_roundtrip_and_legacy_cases(spark):
    qa_rows = spark.createDataFrame([("f", 0, "What is sold?", ["tickets", "passes"]), ("f", 1, "Refund?", ["7 days"])],
                                    "path string, qa_index long, question string, answers array<string>")
    text = qa_text.render(qa_rows)
    back = [(r.question, list(r.answers)) for r in qa_text.parse(text).orderBy("qa_index").collect()]
    assert back == [("What is sold?", ["tickets", "passes"]), ("Refund?", ["7 days"])]
    legacy = "A: orphan\nQ: first\nQ: second\nnoise\nA: plain answer\nA: ignored\nQ:x\nA: ['it''s', 'b']\n"
    files = spark.createDataFrame([("g", legacy)], "path string, value string")
    got = [(r.question, list(r.answers)) for r in qa_text.parse(files).orderBy("qa_index").collect()]
    assert got == [("second", ["plain answer"])]            # a question without text takes no answer


def test_summary_csv(spark):
    df = spark.createDataFrame([("t", "s", [0.5, 0.25], 0.75)],
                               "file_type_name string, chunking_strategy_name string, cosine_similaritys array<double>, "
                               "llm_score_ratio double")
    out = tempfile.mkdtemp(prefix="slicewise-csv-") + "/summary"
    target = write_csv(df, out, datetime.datetime(2024, 5, 6, 7, 8, 9, 10))
    assert target == out + "/experiment_results_20240506_070809_000010"
    with open(glob.glob(target + "/*.csv")[0], "rb") as f:
        raw = f.read()
    assert raw.startswith(b"\xef\xbb\xbffile_type_name,")       # byte-order mark, then the header
    rows = list(csv.DictReader(raw.decode("utf-8-sig").splitlines()))
    assert rows[0]["cosine_similaritys"] == "[0.5,0.25]" and rows[0]["llm_score_ratio"] == "0.75"


def test_index_upsert_and_clear(spark):
    path = tempfile.mkdtemp(prefix="slicewise-idx-") + "/index"
    v1 = spark.createDataFrame([("c1", "a", 1, 0, "t1", [1.0], 0), ("c1", "b", 1, 1, "t2", [2.0], 0),
                                ("c2", "x", 2, 0, "t3", [3.0], 0)],
                               "collection string, chunk_id string, doc_id long, chunk_index long, chunk_text string, "
                               "embedding array<double>, version int")
    assert vector_index.upsert(spark, path, v1).count() == 0
    v2 = spark.createDataFrame([("c1", "a", 1, 0, "t1-new", [9.0], 1), ("c1", "z", 1, 2, "t4", None, 1)], v1.schema)
    rejected = vector_index.upsert(spark, path, v2)
    assert [r.chunk_id for r in rejected.collect()] == ["z"]
    idx = spark.read.parquet(path)
    assert {r.chunk_id: r.chunk_text for r in idx.collect()} == {"a": "t1-new", "b": "t2", "x": "t3"}
    vector_index.clear(spark, path, "c2")
    assert {r.collection for r in spark.read.parquet(path).collect()} == {"c1"}


def test_custom_splitter_registry(spark):
    def chars(text_col, size_col, seps):
        return F.expr(f"transform(split(`{text_col}`, ''), c -> named_struct('p', c, 'f', 2))")
    chunking.register_splitter("every_char", chars)
    df = spark.createDataFrame([(1, "abcdefghij klmno")], "doc_id long, text string").withColumn(
        "chunk_size", F.lit(5)).withColumn("chunk_overlap", F.lit(2))
    got = [r.chunk_text for r in chunking.split_text(df, "every_char").orderBy("chunk_index").collect()]
    assert got == rules.merge(list("abcdefghij klmno"), 5, 2)


def test_generate_qa_with_responder(spark):
    docs = spark.createDataFrame([("a", "Some text."), ("b", "Other text.")], "file_type string, text string")

    def responder(prompts):
        return prompts.select("file_type", F.when(F.col("file_type") == "a", F.lit(
            '```json\n[{"question": "Q?", "answers": ["A1", "A2"]}]\n```')).otherwise(F.lit("sorry")).alias("reply"))

    rows, skipped = qa.generate(docs, templates_table(spark), responder)
    assert [(r.file_type, r.question, list(r.answers)) for r in rows.collect()] == [("a", "Q?", ["A1", "A2"])]
    assert [r.file_type for r in skipped.collect()] == ["b"]


def test_render_matches_python_list_repr(spark):
    items = ["plain", "it's", 'say "hi"', "both ' and \"", "back\\slash", "two\nlines"]
    qa_rows = spark.createDataFrame([("f", 0, "Q?", items)],
                                    "path string, qa_index long, question string, answers array<string>")
    text = qa_text.render(qa_rows).collect()[0].value
    assert text == f"Q: Q?\nA: {items!r}\n\n"


def test_upsert_of_an_equal_version_takes_the_new_row(spark):
    from slicewise.sources import vector_index
    shape = "collection string, chunk_id string, chunk_text string, embedding array<double>, version int"
    old = spark.createDataFrame([("c", str(i), "old", [1.0], 0) for i in range(40)], shape)
    new = spark.createDataFrame([("c", str(i), "new", [2.0], 0) for i in range(0, 40, 2)] + [("c", "1", "late", [3.0], -1)], shape)
    for parts in (1, 5):
        merged, _ = vector_index.upsert_frames(old.repartition(parts), new.repartition(parts))
        got = {r.chunk_id: r.chunk_text for r in merged.collect()}
        assert got == {str(i): "old" if i % 2 else "new" for i in range(40)}
