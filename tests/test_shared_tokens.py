"""One tokenisation per document: vectors and cosines of chunks equal those of the chunks by themselves."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slicewise.operators import chunking, shared_tokens, similarity
from slicewise.operators.retrieval import LEXICAL_DIMS, with_lexical_embedding

WORD = re.compile(r"\w{2,}")
STRATEGIES = [{"method": chunking.LINE_MERGE, "separators": None}, {"method": chunking.RECURSIVE, "separators": None},
              {"method": chunking.RECURSIVE, "separators": ["x", ""]}]
SIZES = [(1, 0), (7, 3), (40, 10), (1000, 200)]
TEXTS = ["", " \n \n", "a", "abc abc\nABC_1 x9 é È ñandú\n\n" * 9, "ΟΔΟΣ ΟΔΟΣ'α\nΣΑΣ İstanbul İ", "𝔘𝔫𝔦 𐐀𐐁𐐂 你好世界 12́ab", "nospace" * 60,
         "\t　tab\x1cfs\x85nel   ends  ", "word " * 200 + "\n" + "Tail of THE line\n" * 20, None, "abc abc\nABC_1 x9 é È ñandú\n\n" * 9]


def cosine(chunk: str, doc: str) -> float:
    """A1 by its definition, over the vocabulary of the two texts."""
    a, b = Counter(WORD.findall(chunk.lower())), Counter(WORD.findall(doc.lower()))
    idf = {t: math.log(3 / (1 + (t in a) + (t in b))) + 1 for t in {*a, *b}}
    dot = sum(a[t] * b[t] * idf[t] ** 2 for t in idf)
    na, nb = (math.sqrt(sum((c[t] * idf[t]) ** 2 for t in idf)) for c in (a, b))
    return dot / (na * nb) if na and nb else 0.0


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, t, s["method"], s["separators"], n, o) for i, t in enumerate(TEXTS) for s in STRATEGIES for n, o in SIZES]
    return spark.createDataFrame(rows, "doc_id long, text string, method string, separators array<string>, chunk_size int, chunk_overlap int")


KEYS = ["doc_id", "method", "separators", "chunk_size", "chunk_index"]


def test_vectors_equal_those_of_the_chunks(spark, pairs):
    got = chunking.chunk_pairs(pairs, STRATEGIES, dims=LEXICAL_DIMS).select(*KEYS, "chunk_text", "embedding")
    want = with_lexical_embedding(chunking.chunk_pairs(pairs, STRATEGIES), "chunk_text").select(*KEYS, "chunk_text", "embedding")
    key = lambda r: str(tuple(r)[:5])
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) > 1000 and got == want


def test_other_dimensions(spark, pairs):
    some = pairs.filter("chunk_size = 40")
    got = chunking.chunk_pairs(some, STRATEGIES, dims=10).select(*KEYS, "embedding")
    want = with_lexical_embedding(chunking.chunk_pairs(some, STRATEGIES), "chunk_text", dims=10).select(*KEYS, "embedding")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_cosines_equal_the_definition(spark, pairs):
    lists = chunking.pair_chunk_lists(pairs, STRATEGIES).select("doc_id", "method", "separators", "chunk_size", "chunks").collect()
    got = similarity.pair_chunk_cosines(pairs, STRATEGIES).select("doc_id", "method", "separators", "chunk_size", "cosines").collect()
    assert len(lists) == len(got) > 0
    scores = {str(tuple(r)[:4]): r.cosines for r in got}
    for r in lists:
        assert scores[str(tuple(r)[:4])] == pytest.approx([cosine(c, TEXTS[r.doc_id]) for c in r.chunks], abs=1e-12)


def test_pieces_that_do_not_tile_the_text(spark):
    """A splitter that drops its separator: chunks are ranges of what it keeps, the cosine is with the whole text."""
    chunking.register_splitter("drop_bars", lambda t, n, seps: F.expr(
        f"transform(split(`{t}`, '[|]', -1), p -> named_struct('p', p, 'f', 2))"))
    text = "one two|twothree four|five one|"
    rows = [{"method": "drop_bars", "separators": None}]
    df = spark.createDataFrame([(1, text, "drop_bars", None, 16, 0)],
                               "doc_id long, text string, method string, separators array<string>, chunk_size int, chunk_overlap int")
    chunks = chunking.pair_chunk_lists(df, rows).first().chunks
    assert chunks and "|" not in "".join(chunks)
    got = similarity.pair_chunk_cosines(df, rows).first().cosines
    assert got == pytest.approx([cosine(c, text) for c in chunks], abs=1e-12)
    vectors = chunking.chunk_pairs(df, rows, dims=8)
    plain = with_lexical_embedding(chunking.chunk_pairs(df, rows), "chunk_text", dims=8)
    assert vectors.select("chunk_text", "embedding").collect() == plain.select("chunk_text", "embedding").collect()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abÉ_1 \n'ΣİσßŒ你𝔘́", max_size=40), st.data())
def test_spans_are_the_tokens_of_the_part(text, data):
    doc = shared_tokens.DocumentTokens(text)
    names = list(doc.ids)
    ends = [sorted((data.draw(st.integers(0, len(text))), data.draw(st.integers(0, len(text))))) for _ in range(4)]
    begin, end = np.array([a for a, _ in ends]), np.array([b for _, b in ends])
    first, after, words = doc.spans(begin, end)
    for k, (a, b) in enumerate(ends):
        found = [names[i] for i in doc.tokens[first[k]:after[k]]] + [w for j, w in words if j == k]
        assert Counter(found) == Counter(WORD.findall(text[a:b].lower()))


def test_a_text_is_tokenised_once(monkeypatch):
    made = []
    init = shared_tokens.DocumentTokens.__init__
    monkeypatch.setattr(shared_tokens.DocumentTokens, "__init__", lambda self, text: (made.append(text), init(self, text))[1])
    last = shared_tokens.LastTokens()
    for text in ["a b", "a b", "c", "c", "c"]:
        last.of(text)
    assert made == ["a b", "c"]


def test_plan_runs_the_walk_once(spark, pairs):
    for df in (chunking.chunk_pairs(pairs, STRATEGIES, dims=8), similarity.pair_chunk_cosines(pairs, STRATEGIES)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_word_places_are_those_of_the_pattern():
    odd = "".join(map(chr, [*range(0x3000), *range(0xD7F0, 0xD810), *range(0xFE00, 0x10500), 0x1D518, 0x10FFFF]))
    for text in [*filter(None, TEXTS), "", odd, odd[::-1], "_", "__", "a_", " ab", "ab "]:
        starts, ends = shared_tokens.word_places(text)
        assert list(zip(starts.tolist(), ends.tolist())) == [m.span() for m in WORD.finditer(text)]


def test_words_of_a_large_vocabulary_are_hashed_once():
    words = [f"w{i}" for i in range(100_000)]
    shared_tokens.token_bucket.cache_clear()
    for _ in range(2):
        for word in words:
            shared_tokens.token_bucket(word, LEXICAL_DIMS)
    assert shared_tokens.token_bucket.cache_info().misses == len(words)
