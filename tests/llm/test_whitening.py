import math
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import whitening

NAN, INF = float("nan"), float("inf")


def plain(rows, components):
    """Exact numbers by fractions, components by the library's solver."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = [[Fraction(a) - Fraction(s, n) for a, s in zip(x, sums)] for x in fit]
    cov = np.array([[float(sum(x[i] * x[j] for x in centred) / n) for j in range(len(sums))] for i in range(len(sums))])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, len(sums))
    out = {}
    for i, x in good:
        y = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)])
        out.setdefault(i, []).append((n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (y @ v)[:k] / np.sqrt(e[:k])))
    return out, e[:k] / np.trace(cov)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "7 as x", "'a' as n", "1 as component").repartition(3)


def random_rows(seed, n, dim):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((dim, dim)) * np.linspace(0.1, 2, dim)
    rows = [(i, [float(np.float32(c)) for c in mix @ rng.standard_normal(dim) + 3]) for i, _ in enumerate(range(n))]
    return rows


@pytest.mark.parametrize("n,dim", [(300, 20), (150, 5), (400, 33)])
def test_against_exact_arithmetic(spark, n, dim):
    rows = random_rows(n, n, dim)
    rows += [(n + i, rows[7][1]) for i in range(50)] + [(None, rows[3][1]), (5, rows[4][1]), (5, rows[4][1])]
    bad = [(900, None), (901, []), (902, [NAN] + [1.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1)), (904, [-INF] + [1.0] * (dim - 1)), (905, [1.0] * (dim + 1))]
    want, shares = plain(rows, 16)
    got = whitening.whiten_vectors(table(spark, rows + bad)).collect()
    assert len(got) == len(rows) and {r.vec_id for r in got} == {i for i, _ in rows}
    same = {i: z for i, found in want.items() for _, _, z in found[:1]}
    signs = None
    for r in got:
        assert (r.n, r.deviation) in [(a, b) for a, b, _ in want[r.vec_id]]
        assert 0 <= r.identity_error < 1e-9 and np.allclose(r.explained, shares, rtol=1e-9)
        nearest = min(want[r.vec_id], key=lambda w: abs(w[1] - r.deviation))[2]
        if signs is None:
            signs = np.sign(np.array(r.whitened) * nearest)
        assert np.allclose(np.array(r.whitened) * signs, nearest, atol=1e-7), same


def test_rows_by_component(spark):
    rows = random_rows(1, 60, 20)
    got = whitening.by_component(whitening.whiten_vectors(table(spark, rows)))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    assert sorted((r.vec_id, r.component) for r in found) == [(i, c) for i in range(60) for c in range(1, 17)]
    again = {(r.vec_id, r.component): r.whitened for r in whitening.by_component(whitening.whiten_vectors(table(spark, rows).repartition(7))).collect()}
    assert all(math.isclose(again[r.vec_id, r.component], r.whitened, rel_tol=1e-11, abs_tol=1e-12) for r in found)


def test_no_variance_and_empty_tables(spark):
    one = whitening.whiten_vectors(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], None)] * 2
    flat = whitening.whiten_vectors(table(spark, [(i, [float(i), 2.0]) for i in range(4)])).collect()
    assert all(r.whitened[1] is None and r.whitened[0] is not None for r in flat)
    assert whitening.whiten_vectors(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten_vectors(table(spark, [(1, [1.0])]).limit(0)).collect() == []


def test_huge_entries_are_exact_or_null(spark):
    rows = [(1, [1e38, 0.0]), (2, [-1e38, 1.0]), (3, [1e6, 5.0]), (4, [0.0, 9.0])]
    got = {r.vec_id: r for r in whitening.whiten_vectors(table(spark, rows)).collect()}
    assert got[1].deviation is None and all(math.isfinite(r.whitened[0]) for r in got.values())
    small = {r.vec_id: r.deviation for r in whitening.whiten_vectors(table(spark, [(1, [3e6]), (2, [-3e6]), (3, [1.0])])).collect()}
    xs = {i: math.floor(64 * v) + 1_000_000 for i, v in ((1, 3e6), (2, -3e6), (3, 1.0))}
    assert small == {i: (3 * x - sum(xs.values())) ** 2 for i, x in xs.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 150])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    for e in (rng.random(n), np.ones(n), np.repeat([3.0, 1.0], [n // 2, n - n // 2]), np.logspace(0, -12, n), np.arange(n) - n // 2.0, np.zeros(n)):
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors = whitening.components_of(a)
        scale = max(np.abs(e).max(), 1e-300)
        assert np.abs(values - np.sort(e)[::-1]).max() < 1e-13 * scale * n
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale * n


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    e = np.concatenate((np.logspace(-9, 0, 15), -np.logspace(-9, 0, 15)))
    assert np.abs(whitening.polar((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-6
