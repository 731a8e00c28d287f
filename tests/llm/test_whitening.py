"""Whitening against a dense eigendecomposition in numpy, and exact sums in Python's whole numbers."""

import math
import random

import numpy as np
import pytest

from slicewise.llm import whitening


def plain(vectors, k=16):
    """n, deviations, eigenvalues, components of the distinct whole-number vectors."""
    whole = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in vectors}
    fit = sorted({tuple(x) for x in whole.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = np.array([[float(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    _, s, vt = np.linalg.svd(far)
    e = s ** 2 / n
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in whole.items()}
    deviation = {i: v if v < 1 << 63 else None for i, v in deviation.items()}
    white = {i: np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)]) @ vt[:k].T / np.sqrt(np.maximum(e[:k], 1e-300)) for i, x in whole.items()}
    return n, deviation, e[:k], e.sum(), white


def vectors(n, d, seed, scale=None):
    rng = np.random.default_rng(seed)
    scale = np.linspace(3, 0.3, d) if scale is None else np.array(scale)
    return [(i, [float(np.float32(c)) for c in rng.normal(0, 1, d) * scale]) for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, "x", 5, [1]) for i, v in rows], "vec_id long, embedding array<float>, n string, component int, x array<int>").repartition(parts)


def check(spark, rows, k=16):
    got, model = whitening.whiten(frame(spark, rows), k=k)
    n, deviation, eigen, trace, white = plain(rows, k)
    assert model.n == n and model.identity_error <= 1e-10
    assert np.allclose(model.eigenvalues, eigen[:len(model.eigenvalues)], rtol=1e-8)
    assert np.allclose(model.explained, eigen[:len(model.eigenvalues)] / trace, rtol=1e-8)
    out = got.collect()
    assert sorted((r["vec_id"], r["deviation"]) for r in out) == sorted(deviation.items())
    signs = None
    for r in out:
        w, p = np.array(r["whitened"]), white[r["vec_id"]][:len(model.eigenvalues)]
        if signs is None and (np.abs(p) > 1e-3).all():
            signs = np.sign(w) * np.sign(p)
        if signs is not None:
            assert np.allclose(w, p * signs, atol=1e-6)
    return model


def test_whitening_equals_eigendecomposition(spark):
    rows = vectors(400, 20, 1)
    assert check(spark, rows + [(1000 + i, v) for i, v in rows[:50]]).components.shape == (20, 16)
    check(spark, vectors(300, 6, 2), k=3)


def test_ill_conditioned_rows(spark):
    check(spark, vectors(500, 8, 3, [1e6, 1e5, 1e4, 1e3, 100, 10, 1, 0.5]))


def test_fewer_dimensions_than_components(spark):
    rng = random.Random(4)
    base = [(i, [float(rng.randrange(-50, 50)) for _ in range(3)]) for i in range(200)]
    rows = [(i, [a, b, a + b, 7.0, c, -c]) for i, (a, b, c) in base]      # three directions, a constant, two dependent columns
    assert check(spark, rows).components.shape == (6, 3)


def test_whitening_cases(spark):
    odd = [(None, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0, 2.0, 3.0]),
           (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [4.0, -2.0]), (9, [0.5, 0.25])]
    got, model = whitening.whiten(frame(spark, odd))
    assert model.n == 3 and sorted((r["vec_id"] or 0) for r in got.collect()) == [0, 7, 7, 8, 9]
    assert whitening.whiten(frame(spark, odd).limit(0))[0].count() == 0
    one, none = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert none is None and one.count() == 0
    huge, model = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [0.0, 5.0]), (3, [1.0, 1.0])]))
    assert model.n == 3 and {r["vec_id"]: r["deviation"] for r in huge.collect()}[1] is None


def test_whole_numbers_are_exact_beyond_longs():
    x = np.array([[1 << 60, -5], [3, 1 << 59]], dtype=np.int64)
    assert whitening._centred(x, 1000, [7, 9]).tolist() == [[(1 << 60) * 1000 - 7, -5009], [2993, (1 << 59) * 1000 - 9]]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, deviation, eigen, trace, _ = plain(rows)
    out = whitening.op13_embedding_whitening(spark, sf).collect()
    assert len(out) == len(rows) * 16
    for r in out:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] <= 1e-10
        assert r["explained"] == pytest.approx(eigen[r["component"] - 1] / trace, rel=1e-9)
