"""The n-gram Jaccard join against all pairs of whole shingle sets."""

import random

import brute
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slicewise.llm import near_dedup, ngram_join


def key(t):
    return tuple((x is None, x if x is not None else 0) for x in t)


def shingles(text, width=3):
    w = brute.SPACED.findall((text or "").translate(brute.UP))
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain(data, similarity=90, width=3):
    sets = [shingles(t, width) for _, t in data]
    top = list(range(len(data)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    ids: dict = {}
    for i, (d, _) in enumerate(data):
        ids.setdefault(find(i), []).extend([] if d is None else [d])
    return sorted(((d, len(s), min(ids[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True))), key=key)


def joined(spark, data, parts=4, **kw):
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in data], "doc_id long, text string, n int, sigs string, rep int").repartition(parts)
    got = ngram_join.jaccard_components(df, **kw)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=key)


def edited(base, k, rng, tag):
    words = list(base)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"e{tag}x{i}"
    return " ".join(words)


def corpus():
    """Groups at, above and below the threshold, a shared passage, short texts, and awkward rows."""
    rng = random.Random(3)
    texts = []
    for g, size in enumerate([9, 12, 20, 40, 130, 400]):
        base = [f"g{g}w{rng.randrange(10 ** 6)}" for _ in range(size)]
        texts += [edited(base, min(k, size // 4), rng, f"{g}_{k}") for k in (0, 0, 1, 1, 2, 3, 5, 8, 20)] + [" ".join(base[1:]), " ".join(base[2:]), " ".join([*base, "tail"])]
    passage = [f"p{i}" for i in range(60)]
    for i in range(60):
        own = [f"o{i}n{k}" for k in range(rng.randrange(2, 40))]
        texts.append(" ".join(own + passage))
    texts += ["a b", "A  b", "a b c", "a b c d", "b a", "one", "ONE", " ", ""]
    return [(len(texts) - i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in brute.odd_rows()]


@pytest.mark.parametrize("similarity", [90, 80, 65])
def test_join_equals_brute_force(spark, similarity):
    data = corpus()
    assert joined(spark, data, similarity=similarity) == plain(data, similarity)


def test_frequent_tokens_lose_no_link(spark, monkeypatch):
    """Few counters make every token frequent, so prefixes hold token combinations only; lists are dense and blocks small."""
    for module, name, value in ((ngram_join, "SKETCH_BITS", 8), (ngram_join, "SMALL", 3), (ngram_join, "BLOCK", 8), (ngram_join, "BLOCK_TOKENS", 900), (near_dedup, "BLOCK", 8)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(8)
    base, other = [f"b{i}" for i in range(150)], [f"b{i}" for i in range(120)] + [f"o{i}" for i in range(30)]
    chain, texts = list(base), []
    for k in range(40):
        texts += [edited(x, rng.randrange(4), rng, k) for x in (base, other)]
        chain[(k * 3) % 150] = f"c{k}"
        texts.append(" ".join(chain))
    data = list(enumerate(texts))
    assert joined(spark, data) == plain(data)


def test_pairs_of_short_lists_grow_with_members_not_with_their_square(spark, monkeypatch):
    """Near copies that all meet in short lists are connected by a few pairs each; links between clusters stay."""
    counts, rng = [], random.Random(5)

    def counted(scratch, edges, real=ngram_join.components):
        counts.append(edges.count())
        return real(scratch, edges)

    monkeypatch.setattr(ngram_join, "components", counted)
    monkeypatch.setattr(ngram_join, "SMALL", 200)
    texts = [edited([f"{g}w{i}" for i in range(300)], k % 5, rng, f"{g}_{k}") for g in "ab" for k in range(80)]
    data = list(enumerate(texts))
    assert joined(spark, data) == plain(data)
    assert 0 < max(counts) <= 2 * ngram_join.PIVOTS * len(data)


def test_stragglers_of_one_family_are_joined_by_a_forest():
    """Stragglers that are all alike cost a block one pair for each component it joins; those that are not alike stay apart."""
    reps = np.arange(60)
    members = pd.DataFrame({"rep": reps, "comp": np.where(reps < 10, 0, reps)})
    kind = reps % 2

    def compare(asks, members):
        return (kind[members["rep"]] == kind[r] for r in asks["rep"])

    pairs = near_dedup._family(compare)((0, 0, 0), members[reps >= 10], members)
    assert len(pairs) == 50 and (kind[pairs["a"]] == kind[pairs["b"]]).all()
    top = list(members["comp"])
    for a, b in pairs.itertuples(index=False):
        top = [top[a] if x == top[b] else x for x in top]
    assert len(set(top)) == 1                                           # the main component holds both kinds


def test_stragglers_cost_pairs_in_proportion_to_their_number(spark, monkeypatch):
    """Near copies of one text that their pivots leave apart enter the components' joins as a forest for each block, not as all pairs."""
    counts, rng = [], random.Random(6)

    def counted(scratch, edges, real=near_dedup.components):
        counts.append(edges.count())
        return real(scratch, edges)

    monkeypatch.setattr(ngram_join, "components", counted)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "_possible_pairs", lambda similarity: lambda batches: (b.select(["a", "b"]).slice(0, 0) for b in batches))      # no pivot helps
    data = [(i, edited([f"w{k}" for k in range(300)], i % 5, rng, i)) for i in range(120)]
    assert joined(spark, data) == plain(data)
    assert len(data) // 2 < max(counts) < 4 * len(data)


@settings(max_examples=300, deadline=None)
@given(st.integers(9, 120), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10 ** 6), st.sampled_from([80, 90, 95]), st.floats(0, 1))
def test_linked_sets_share_a_signature(n, less, more, seed, similarity, frequent):
    """Whatever the classes of the tokens, two sets similar enough share a signature (or are equal)."""
    rng = np.random.default_rng(seed)
    codes = np.where(rng.random(1 << 12) < frequent, rng.integers(0, 40, 1 << 12), 0).astype(np.uint8)
    order = ngram_join.Order(codes.tobytes(), 0, ngram_join._classes(similarity))
    x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    y = np.unique(np.concatenate([x[rng.permutation(len(x))[less:]], rng.integers(0, 1 << 64, more, dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if len(y) and 100 * both >= similarity * (len(x) + len(y) - both) and both < max(len(x), len(y)):
        a, b = (ngram_join.signatures(order, s, similarity) for s in (x, y))
        assert len(np.intersect1d(a, b))
        h = [ngram_join._rows([ngram_join.bucket_counts(s)]) for s in (x, y)]
        assert ngram_join._possible(h[0], len(x), h[1], np.array([len(y)]), similarity).all()


def test_rare_tokens_are_indexed_singly_and_prefixes_stay_short():
    order = ngram_join.Order(bytes(1 << 12), 0, 3)
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 900, dtype=np.uint64))
    assert len(ngram_join.signatures(order, x, 90)) == 101
    high = ngram_join.Order(bytes([40]) * (1 << 12), 0, 3)
    assert len(ngram_join.signatures(high, x, 90)) == 301           # windows of three neighbours


def test_join_cases(spark):
    docs = brute.odd(spark)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    alone = ngram_join.jaccard_components(docs.filter("text IS NULL")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in alone), key=key) == [(2, 0, 2), (None, 0, None)]
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(docs, similarity=40)
