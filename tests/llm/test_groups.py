"""Top-k search, exact and near duplicates, repeated lines, licences, pipeline."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slicewise.llm import exact_dedup, license_scan, line_dedup, near_dedup, packing, topk
from slicewise.llm.common import Scratch


def key(t):
    return tuple((x is None, x if x is not None else 0) for x in t)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


# top-k

def plain_top(vectors, asked, k):
    out = []
    q8 = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in asked:
        if q in q8:
            s = sorted((-sum(a * b for a, b in zip(q8[q], v, strict=True)), i) for i, v in q8.items() if i != q and len(v) == len(q8[q]))[:k]
            out += [(q, r, i, -n) for r, (n, i) in enumerate(s, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(700)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(40)] + [(2000, [0.0] * 8), (2001, None), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8),
                                                             (2004, [float("inf")] * 8), (2005, []), (2006, [0.1, 0.2]), (2007, [0.3, 0.4])]
    asked = [0, 7, 1000, 2000, 2001, 2003, 2006]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, rank string, score int").repartition(4)
    got = topk.top_k(df.union(df.filter("vec_id < 20")), df.filter(F.col("vec_id").isin(asked)), 5, shard=200, block=3)
    assert rows(got, "query_id", "rank", "vec_id", "score") == plain_top(vectors, asked, 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    m = np.floor(rng.normal(0, 40, (5000, 3)))
    m[17] = [900, 900, 900]
    ids, scores, depth = topk.threshold_search(np.arange(5000), m, np.argsort(m, axis=0).T.copy(), -1, np.array([3.0, 2.0, 1.0]), 1)
    assert ids.tolist() == [17] and depth < 500


# exact dedup

def plain_exact(data):
    best, n = {}, {}
    norm = [(t or "").translate(brute.UP) for _, t in data]
    for (d, _), t in zip(data, norm, strict=True):
        n[t] = n.get(t, 0) + 1
        if t not in best or best[t] is None or (d is not None and d > best[t]):
            best[t] = d
    return norm, best, n


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_brute_force(spark, weak):
    rng = random.Random(2)
    data = [(r[0], r[1]) for r in brute.odd_rows()] + [(100 + i, rng.choice(["Same text", "same TEXT", "sÄme", "säme", f"t{i % 20}"])) for i in range(150)]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, rid int, digest string").repartition(5)
    got = exact_dedup.dedup(df, (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256)
    norm, best, n = plain_exact(data)
    want = sorted(((d, best[t], n[t], hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(data, norm, strict=True)), key=key)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = got.filter("kept").select("doc_id", "keep_id", "text_sha256").collect()
    assert len(kept) == len(set(norm)) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_cases(spark):
    docs = brute.odd(spark)
    kept = exact_dedup.kept_rows(docs)
    assert kept.schema == docs.schema and kept.count() == len({(t or "").translate(brute.UP) for _, t, *_ in brute.odd_rows()})
    assert exact_dedup.dedup(docs.limit(0)).count() == 0 and exact_dedup.kept_rows(docs.limit(0)).count() == 0


def test_stream_goes_on_with_its_state(spark):
    scratch = Scratch(spark)
    source, state = scratch.path("source"), scratch.path("state")
    part = lambda ids: exact_dedup.digest_rows(spark.createDataFrame([(i, "Ab" if i % 2 else "cd") for i in ids], "doc_id long, text string"))
    part([1, 2, 3]).write.parquet(source)
    schema = spark.read.parquet(source).schema
    first = rows(exact_dedup.advance(spark, source, schema, state).select(F.col("keeper.doc_id").alias("d"), "group_size"), "d", "group_size")
    part([9, 4]).write.mode("append").parquet(source)
    then = rows(exact_dedup.advance(spark, source, schema, state).select(F.col("keeper.doc_id").alias("d"), "group_size"), "d", "group_size")
    assert first == [(2, 1), (3, 2)] and then == [(4, 2), (9, 3)]


# near dedup

def near_rows(spark, data, parts=4):
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, n int, node string").repartition(parts)
    return rows(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")


def test_near_dedup_equals_brute_force(spark):
    texts = brute.near_copies(150, 5, 1) + brute.near_copies(6, 14, 2) + brute.near_copies(30, 12, 3, 200) + brute.near_copies(4, 1, 4, 6)
    texts += [" ".join(f"u{i}w{k}" for k in range(30)) for i in range(60)] + ["a b", "A B", "a", "b", "  "]
    data = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in brute.odd_rows()]
    assert near_rows(spark, data) == sorted(brute.near_components(data), key=key)


def test_dense_nodes_lose_no_link(spark, monkeypatch):
    """Two groups of copies that share most tokens, and a chain of texts that drift apart."""
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    other = base[:115] + [f"o{i}" for i in range(35)]
    chain, texts = list(base), []
    for k in range(60):
        texts += [" ".join(w if rng.random() > 0.02 else f"r{k}{j}" for j, w in enumerate(x)) for x in (base, other)]
        chain[(k * 3) % 150] = f"c{k}"
        texts.append(" ".join(chain))
    data = list(enumerate(texts))
    assert near_rows(spark, data) == sorted(brute.near_components(data), key=key)


def test_near_stage_equals_five_word_brute_force(spark):
    base = [f"w{i}" for i in range(100)]
    edited = lambda k: " ".join(f"e{k}x{i}" if i % 11 == 5 and i // 11 < k else w for i, w in enumerate(base))
    texts = [" ".join(base), edited(2), edited(3), edited(4), edited(5), "a b c d", "A b  c D", "a b c", "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(d for d, _, _, kept in brute.near_components(list(enumerate(texts)), 5) if kept)
    assert want == [0, 2, 3, 4, 5, 7, 8, 9]
    assert [d for d, in rows(corpus_pipeline.near(spark, docs, ""), "doc_id")] == want


def test_near_kept_rows_equal_brute_force(spark):
    """Of each component one row stays, whatever ids its rows share with others."""
    copy = " ".join(f"k{i}" for i in range(40))
    data = [(r[0], r[1]) for r in brute.odd_rows()] + [(None, "only here"), (None, copy), (None, copy + " x"), (20, copy), (20, copy), (20, "nothing alike"),
                                                       (21, copy + " y"), (22, None), (22, "z z z"), (None, "null ids alone"), (None, "null ids  ALONE")]
    docs = spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, n int, row string").repartition(3)
    got = near_dedup.kept_rows(docs)
    want = [(d, t) for d, t in data if not brute.shingles(t)]
    want += [(1, "The quick brown fox\njumps over"), (4, brute.LONG), (6, "12 345 !!"), (7, "einwort"), (1, "ein ganz anderer Text"), (10, "é ß 日本語 \U0001F600"),
             (None, "only here"), (20, copy), (20, "nothing alike"), (22, "z z z")]
    found = rows(got, "doc_id", "text")
    alone = [x for x in found if x[1] and x[1].startswith("null ids")]
    assert got.schema == docs.schema and len(alone) == 1 and alone[0][0] is None
    assert [x for x in found if x not in alone] == sorted(want, key=key)


def test_near_dedup_cases(spark):
    docs = brute.odd(spark)
    assert near_dedup.kept_rows(docs).schema == docs.schema
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dedup.near_duplicates(docs.filter("text IS NULL")).count() == 2


# line dedup

def plain_lines(data, min_words):
    order = sorted(range(len(data)), key=lambda i: key((data[i][0],)))
    gone = dict(zip(order, brute.copied_lines([data[i] for i in order], min_words), strict=True))
    return sorted(((d, 0 if t is None else t.count("\n") + 1, len(gone[i]), tuple(sorted(gone[i]))) for i, (d, t) in enumerate(data)), key=key)


@pytest.mark.parametrize("min_words", [1, 7, 20])
def test_line_dedup_equals_brute_force(spark, min_words):
    rng = random.Random(min_words)
    lines = [" ".join(f"l{i}" for _ in range(rng.randrange(0, 9))) for i in range(12)] + ["", "hot line of five words"]
    data = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 16)))) for i in range(40)]
    block = "\n".join(f"block line {i} with words" for i in range(20))
    data += [(100 + i, f"head {i}\n{block}\ntail {i}") for i in range(5)] + [(200, block.replace("line 7", "Line 7")), (201, None), (202, ""), (203, "a\n\n\n"), (204, "\n")]
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "doc_id long, text string, rid int, ln int").repartition(4)
    got = line_dedup.removed_lines(df, min_words)
    assert sorted(((*r[:3], tuple(r[3])) for r in got.collect()), key=key) == plain_lines(data, min_words)
    texts = {r["doc_id"]: r["text"] for r in line_dedup.without_copies(df, min_words).collect()}
    want = {d: g for d, _, _, g in plain_lines(data, min_words)}
    for d, t in data:
        assert texts[d] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]))


def test_line_dedup_cases(spark):
    docs = brute.odd(spark)
    got = line_dedup.removed_lines(docs, 3)
    assert got.count() == docs.count() and got.filter("n_removed > 0").count() == 1        # the repeated row; case differs elsewhere
    assert line_dedup.without_copies(docs).schema == docs.schema
    assert line_dedup.removed_lines(docs.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()


# licences

def plain_scan(text):
    words = brute.PLAIN.findall((text or "").translate(brute.UP))
    hits = [(i, label) for label, phrase in license_scan.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    labels = {la for _, la in hits}
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted(labels)), labels


def test_license_base_equals_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [t for _, t, *_ in brute.odd_rows()]
    texts += ["cc by cc by", "All rights, reserved", "allrights reserved", "General\nPublic--License cc-by", "all all rights reserved", "cc", "by cc"]
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(texts)], "doc_id long, text string, labels string, rid int").repartition(4)
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, places, first, last, base, labels = plain_scan(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, base)
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["labels"] == "") == (r["score"] == 0)


def test_license_templates(spark):
    cases = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0": "apache", "x Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
             "released by us under the MIT License": "mit", "the mit way, license later": "", "an apache helicopter": "", "apache license": "apache",
             "licensed under the GNU General Public License, version 3": "gpl", "Redistribution and use in source and binary forms, with or without modification": "bsd"}
    df = spark.createDataFrame([(i, f"some words {c} more words {'filler ' * i}") for i, c in enumerate(cases)], "doc_id long, text string")
    got = license_scan.scan(df)
    assert [r["labels"] for r in got.orderBy("doc_id").collect()] == list(cases.values())
    assert "Python" not in got._jdf.queryExecution().toString()
    assert license_scan.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(df, templates=[("x", "some text", "other key")])


# pipeline

def packed_rows(mixed):
    """(doc_id, start, length, ids_crc32, ids) of every piece of (doc_id, text) rows, whole texts through the tokenizer."""
    from tokenizers import Tokenizer
    plain, out = Tokenizer.from_file(packing.vocabulary_path()), []
    for d, t in mixed:
        ids, at = [*plain.encode(t, add_special_tokens=False).ids, packing.END], 0
        while at < len(ids):
            n = min(packing.MAX_LEN, 1 << (len(ids) - at).bit_length() - 1)
            out.append((d, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), ids[at:at + n]))
            at += n
    return sorted(out)


def test_pipeline_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, frames = Scratch(spark), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        frames.append(docs)
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all(f.columns == start.columns for f in frames[:-1])
    data = [(r["doc_id"], r["text"], r["source"]) for r in start.collect()]
    seen = [(d, t, s) for d, t, s in data if any(c.isalpha() for c in t)]
    assert rows(frames[0], "doc_id", "text", "source") == sorted(seen)
    norm, best, _ = plain_exact([(d, t) for d, t, _ in seen])
    seen = [x for x, n in zip(seen, norm, strict=True) if best[n] == x[0]]
    assert rows(frames[1], "doc_id", "text", "source") == sorted(seen)
    keep = {d for d, _, _, kept in brute.near_components([(d, t) for d, t, _ in seen], corpus_pipeline.NEAR_WORDS) if kept}
    seen = [x for x in seen if x[0] in keep]
    assert rows(frames[2], "doc_id", "text", "source") == sorted(seen)
    mixed = brute.mixed_rows(seen)
    assert rows(frames[3], "doc_id", "text") == mixed
    assert frames[3].filter("n_chars <> length(text)").count() == 0
    pieces = packed_rows(mixed)
    assert frames[4].select("sequence_id").distinct().count() == frames[4].count()
    assert sorted((*r[:4], list(r[4])) for r in frames[4].select("doc_id", "start", "length", "ids_crc32", "ids").collect()) == pieces
    assert rows(corpus_pipeline.run(spark, sf_dir), "doc_id", "start", "ids_crc32") == sorted((d, a, c) for d, a, _, c, _ in pieces)


def test_pipeline_passes_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == 0


CLASHES = ["_id", "_rid", "_words", "_digest", "_digest_here", "_metadata", "row", "place", "file", "at", "rid", "taken", "passes", "end", "pass", "gone", "comp", "n", "d", "size", "words", "kept"]


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Every stage gives its rows back with whatever columns they have, from files or not."""
    data = [(i, f"some words of text number {i % 7} that stay in English, more or less {i % 7}", "en", f"s{i % 2}", 3, *[f"{c}{i}" for c in CLASHES]) for i in range(20)]
    docs = spark.createDataFrame(data, ["doc_id", "text", "lang", "source", "n_chars", *CLASHES])
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, "").collect()
            assert out and all(tuple(r)[5:] == data[r["doc_id"]][5:] for r in out)


def test_exact_stage_keeps_the_largest_row_number(spark):
    """Rows that repeat an id and a text differ in other columns only: the last one stays, in every run."""
    docs = spark.createDataFrame([(1, "a b", 7), (1, "A b", 8), (2, "z", 1), (None, "z", 2)], "doc_id long, text string, x int").coalesce(1)
    for _ in range(2):
        assert rows(exact_dedup.kept_rows(docs), "doc_id", "text", "x") == [(1, "A b", 8), (2, "z", 1)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_kept_rows_with_any_digest(spark, weak):
    data = [(r[0], r[1]) for r in brute.odd_rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = rows(exact_dedup.kept_rows(docs, (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256), "doc_id", "text")
    norm, best, _ = plain_exact(data)
    assert sorted(((d, (t or "").translate(brute.UP)) for d, t in got), key=key) == sorted({(best[t], t) for t in norm}, key=key)


def test_language_stage_without_labels_keeps_documents(spark):
    docs = spark.createDataFrame([(1, "words in some language", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert rows(corpus_pipeline.language(spark, docs, ""), "doc_id") == [(1,)]
