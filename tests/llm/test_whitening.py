"""Embedding whitening against numpy's eigensolver and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pagetrail.llm import whitening


def brute(rows):
    """Whitening by numpy of (id, vector) rows; components with their signs left open."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in kept]
    fit = sorted({tuple(v) for _, v in x})
    n, dims = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return x, n, sums, values[::-1], vectors[:, ::-1], np.trace(cov)


def test_against_numpy(spark):
    g = np.random.default_rng(3)
    base = g.normal(0, 0.3, (400, 24)) @ np.diag(np.linspace(0.5, 3, 24))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)]  # one hot vector
    rows += [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, []), (2002, [None] + rows[0][1][1:]), (2003, [float("nan")] + rows[0][1][1:]), (2004, rows[0][1][:-1] + [float("-inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'a' as component", "1 as n", "0 as x").repartition(7)
    x, n, sums, values, vectors, trace = brute(rows)
    out = whitening.whitened(df).collect()
    assert len(out) == 16 * len(x) == 16 * (400 + 200 + 2)
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, v in x:
        exact = [n * c - s for c, s in zip(v, sums)]
        for k in range(16):
            r = by[i][k + 1][0]
            want = float(np.array(exact) / n @ vectors[:, k] / math.sqrt(values[k]))
            if abs(want) > 1e-3:
                sign = signs.setdefault(k, math.copysign(1, want) * math.copysign(1, r.whitened))
                assert r.whitened * sign == pytest.approx(want, rel=1e-9, abs=1e-9)
            assert r.n == n and r.deviation == sum(e * e for e in exact)
            assert r.explained == pytest.approx(values[k] / trace, rel=1e-10)
            assert r.identity_error < 1e-9
    assert len(by[5][1]) == 2 and len({r.whitened for r in by[5][1]}) == 1
    few = whitening.whitened(df.coalesce(1)).collect()
    key = lambda r: (r.vec_id is None, r.vec_id, r.component)
    for a, b in zip(sorted(out, key=key), sorted(few, key=key)):
        assert (a.deviation, a.explained) == (b.deviation, b.explained) and a.whitened == pytest.approx(b.whitened, abs=1e-12)


def test_eigensolver_against_numpy():
    g = np.random.default_rng(1)
    q, _ = np.linalg.qr(g.normal(size=(40, 40)))
    spectra = [np.linspace(9, 1, 40), np.r_[[5.0] * 7, [4.9999999999] * 5, np.zeros(28)], np.r_[[3.0], np.full(39, 1e-9)], np.full(40, 2.0), np.geomspace(1e6, 1e-6, 40)]
    for spectrum in spectra:
        a = q @ np.diag(spectrum) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.leading(a, 16)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:16], rtol=0, atol=1e-13 * spectrum[0])
        assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * spectrum[0]
    for a in (np.diag([3.0, 1.0, 2.0]), np.array([[2.0]]), np.array([[2.0, 1.0], [1.0, 2.0]]), np.zeros((3, 3)), np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]]))):
        values, vectors = whitening.leading(a, 2)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], atol=1e-13)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-13) and np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_sturm_counts():
    g = np.random.default_rng(2)
    d, e = g.normal(size=12), g.normal(size=11)
    e[4] = 0
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    x = np.linspace(-5, 5, 101)
    assert whitening.below(d, e, x).tolist() == [(np.linalg.eigvalsh(t) < v).sum() for v in x]


def test_large_entries_and_means_stay_exact(spark):
    rows = [(i, [30000.0 + (i % 7) / 64, -20000.0 + (i % 5) / 64, float(i % 3) * 500]) for i in range(60)]
    x, n, sums, values, vectors, _ = brute(rows)
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=3).collect()
    assert {r.component for r in out} == {1, 2, 3} and n == 60 and all(r.identity_error < 1e-6 for r in out)
    want = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x}
    assert all(r.deviation == want[r.vec_id] for r in out)


def test_deviation_beyond_a_long_is_null():
    wide = np.array([[2**32, 2**32], [1, 2]], np.int64)
    assert whitening.deviations(wide).to_pylist() == [None, 5]
    assert whitening.deviations(np.array([[2**31, 2**31], [3, 4]], np.int64)).to_pylist() == [None, 25]
    assert whitening.deviations(np.array([[2**31, 2**31 - 1]], np.int64)).to_pylist() == [2**62 + (2**31 - 1) ** 2]


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(5)], schema)  # one direction only
    got = whitening.whitened(line).collect()
    assert {r.component for r in got} == {1} and all(r.explained == pytest.approx(1) for r in got)
    with pytest.raises(Exception, match="different lengths"):
        whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], schema)).count()
