"""Alignment against whole texts encoded and aligned in one go, and the fragments' laws."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slicewise.llm import alignment
from slicewise.llm.packing import vocabulary_path

PATHS = vocabulary_path(alignment.FIRST), vocabulary_path(alignment.SECOND)


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(data):
    """Rows of (doc_id, text) data: tokens, offsets where both end, groups, links."""
    from tokenizers import decoders
    a, b = encoders()
    decode = decoders.ByteLevel()
    vocab = {i: p for p, i in a.get_vocab().items()}
    rows, links = [], []
    byte_of = alignment._byte_of()
    for d, t in data:
        raw = (" " + (t or "")).encode()
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        pa_ = [bytes(byte_of[c] for c in vocab[i]) for i in ia]
        assert not t or decode.decode([vocab[i] for i in ia]) == " " + t
        pb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or b"".join(pa_) != raw or b"".join(pb) != raw:
            rows.append([d, 0, 0, 0, ""])
            links.append([])
            continue
        ea, eb = np.cumsum(list(map(len, pa_))).tolist(), np.cumsum(list(map(len, pb))).tolist()
        at_a, at_b = dict(zip(ea, ia, strict=True)), dict(zip(eb, ib, strict=True))
        both, low, groups = sorted(set(ea) & set(eb)), 0, []
        for e in both:
            sides = (",".join(str(ids[k]) for k in range(bisect_right(ends, low), bisect_right(ends, e))) for ends, ids in ((ea, ia), (eb, ib)))
            groups.append("|".join(sides))
            low = e
        rows.append([d, len(ia), len(ib), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links.append([(at_a[e], at_b[e]) for e in both])
    counts = Counter(x for ls in links for x in ls)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted(((d, n_a, n_b, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), sha)
                   for (d, n_a, n_b, g, sha), ls in zip(rows, links, strict=True)), key=lambda r: (r[0] is None, r))


def found(spark, data, **kw):
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in data], "doc_id long, text string, n_a int, pairs string, rid int").repartition(3)
    return sorted(map(tuple, alignment.align(df, **kw)[0].collect()), key=lambda r: (r[0] is None, r))


def words(rng, n):
    return "".join(rng.choice([" the", " Wort", "\n", "  ", " x1 ", "日本語", " é", "\t", "'s", " <s>", "<|endoftext|>", " ▁", " ab.cd", " ", "\U0001F600"]) for _ in range(n))


def data():
    rng = random.Random(6)
    short = [words(rng, rng.randrange(40)) for _ in range(60)]
    long = [" ".join(words(rng, 6) for _ in range(300)), "x" * 6000, "日本" * 2000, "ab " * 3000, " " * 3000, "▁" * 50 + " ok " * 700]
    return [(i, t) for i, t in enumerate([*short, *long, "plain words here", "<s> </s>", "▁ is a blank's sign"])] + [(r[0], r[1][:9000] if r[1] else r[1]) for r in brute.odd_rows()]


def test_alignment_equals_whole_texts(spark):
    assert found(spark, data()) == plain(data())


def test_long_documents_over_many_tasks(spark, monkeypatch):
    """Chunks of 200 characters, trees of fan 3, and few pairs sent to the tasks: the same results."""
    monkeypatch.setattr(alignment, "FAN", 3)
    monkeypatch.setattr(alignment, "HOT_BITS", 3)
    assert found(spark, data(), chunk=200) == plain(data())


def test_alignment_cases(spark):
    assert found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty)[0].count() == 0


def random_tokens(rng, n, most=6):
    """Two tokenizations of n bytes."""
    def cut():
        ends, at = [], 0
        while at < n:
            at = min(n, at + rng.randrange(1, most))
            ends.append(at)
        return [rng.randrange(50) for _ in ends], np.array(ends)
    (a, ea), (b, eb) = cut(), cut()
    return a, b, ea, eb


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 90), st.integers(1, 30), st.integers(0, 10 ** 6))
def test_any_ranges_and_any_tree_give_the_same(n, size, seed):
    rng = random.Random(seed)
    a, b, ea, eb = random_tokens(rng, n)
    whole = alignment.in_tree(list(alignment.fragments(a, b, ea, eb, n))).finished()
    parts = list(alignment.fragments(a, b, ea, eb, size))
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i:i + 2] = [parts[i].then(parts[i + 1])]
    assert parts[0].finished() == whole
    assert alignment.EMPTY.then(parts[0]) == parts[0] == parts[0].then(alignment.EMPTY)
    assert len(whole.groups) == len(whole.links) == len(np.intersect1d(ea, eb)) and whole.suffix == ((), ())


def test_open_fragments_are_joined_by_tasks(spark):
    """The tree of tasks on fragments with open ends, cut anywhere, gives the groups of the whole."""
    import pandas as pd
    rng, names = random.Random(4), [c.split()[0] for c in alignment._FRAGMENT.split(", ")]
    for _ in range(30):
        a, b, ea, eb = random_tokens(rng, 60, 9)
        whole = alignment.in_tree(list(alignment.fragments(a, b, ea, eb, 60))).finished()
        texts, rows = [], []
        for k, f in enumerate(alignment.fragments(a, b, ea, eb, 4)):
            texts += [(2 * k + 1, t) for t in f.groups]
            rows.append((7, k, 2 * k, True, f.cut, f.n_a, f.n_b, len(f.groups), *map(list, f.prefix), *map(list, f.suffix)))
        level = pd.DataFrame(rows, columns=names)
        while len(level) > 1:
            folded = pd.concat([alignment._fold((7,), part) for _, part in level.groupby(np.arange(len(level)) // 3)], ignore_index=True)
            closed = folded[folded["text"].notna()]
            texts += list(zip(closed["place"], closed["text"], strict=True))
            level = folded[folded["text"].isna()][names]
        end = level.iloc[0]
        texts.append((end["place"], alignment._closed((tuple(end["pre_a"]), tuple(end["pre_b"])))[0][0]))
        assert tuple(t for _, t in sorted(texts, key=lambda x: x[0])) == whole.groups and end["n_groups"] + 1 == len(whole.groups)
        assert (end["n_a"], end["n_b"]) == (whole.n_a, whole.n_b)


def test_ids_are_the_tokenizers_own():
    """The fast encoder built from the first vocabulary gives the ids of its own tokenizer."""
    a, b = encoders()
    mine = alignment.Aligner(*PATHS)
    texts = [t for _, t in data() if t] + [" \x1c x \x1f", "'S don't 'LL ½²", "\u180e \u200b\u0085"]
    got_a, got_b, ok = mine.encoded(texts)
    for t, x, y, good in zip(texts, got_a, got_b, ok, strict=True):
        if good:
            assert x == a.encode(" " + t, add_special_tokens=False).ids and y == b.encode(t)
    assert sum(ok) > 20


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, alignment.op11_tokenizer_alignment(spark, sf).collect())) == plain(rows)
