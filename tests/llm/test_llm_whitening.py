"""Whitening against numpy on small tables; the exact parts against fractions and plain sums."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from clusterlens.llm import spectrum, whitening

SCHEMA = "vec_id long, embedding array<float>"


def _x(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def _usable(rows):
    sound = [(i, _x(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in sound]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if sound else 0
    return [(i, x) for i, x in sound if len(x) == d]


def _run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op11_whitening(spark, str(tmp_path)).collect()


def _check(got, rows, simple=True):
    used = _usable(rows)
    x = np.array([v for _, v in used], object)
    n, s = len(x), x.sum(0)
    exact = n * (x.T @ x) - np.outer(s, s)
    v = exact.astype(float) / n ** 2
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(v))
    rank = int((values > 1e-9 * values[0]).sum())
    k = min(32, rank)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    centred = np.array([[float(Fraction(int(n * c - t), n)) for c, t in zip(row, s)] for row in x])
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    by_id = {i: at for at, (i, _) in enumerate(used)}
    w = np.zeros((n, k))
    for r in got:
        w[by_id[r.vec_id], r.component - 1] = r.whitened
        apart = sum(int(n * c - t) ** 2 for c, t in zip(x[by_id[r.vec_id]], s))
        assert r.deviation == (apart if apart < 1 << 63 else None)
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
    if simple:
        signs = np.sign((w * want).sum(0))
        assert np.allclose(w * signs, want, atol=1e-6)
    else:  # axes of equal eigenvalues may be any basis
        assert np.allclose(w @ w.T, want @ want.T, atol=1e-6)


def _random(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) @ np.diag(np.linspace(1, 3, d)) * scale).tolist()) for i in range(n)]


def test_equals_numpy_with_nulls_and_copies(spark, tmp_path):
    rows = _random(150, 8, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # a hot vector
    rows += [(2001, None), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8),
             (2005, []), (2006, [1.0] * 5)]
    _check(_run(spark, tmp_path, rows), rows)


def test_more_than_32_dimensions(spark, tmp_path):
    rows = _random(120, 40, 2)
    got = _run(spark, tmp_path, rows)
    assert {r.component for r in got} == set(range(1, 33))
    _check(got, rows)


def test_fewer_rows_than_dimensions_and_constant_entries(spark, tmp_path):
    rows = [(i, v[:3] + [0.5, 7.0] + v[3:]) for i, v in _random(5, 9, 3)]
    _check(_run(spark, tmp_path, rows), rows)


def test_repeated_eigenvalues(spark, tmp_path):
    rows = [(2 * i + (s < 0), [float(s) if j == i else 0.0 for j in range(4)]) for i in range(4) for s in (1, -1)]
    rows = [(i, [c * (2.0 if j == 3 else 1.0) for j, c in enumerate(v)]) for i, v in rows]
    _check(_run(spark, tmp_path, rows), rows, simple=False)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    got = _run(spark, tmp_path, rows)
    assert got == []


def test_large_entries_clashing_names_and_null_ids(spark, tmp_path):
    rows = _random(30, 3, 4, 2.0 ** 24)
    rows[7] = (None, rows[7][1])
    table = [(*r, "x", [1.0], 5) for r in rows]
    got = _run(spark, tmp_path, table, SCHEMA + ", `a.b` string, y array<float>, n int")
    _check(got, rows)
    rows = [(1, [3.0e38, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 2.5]), (4, [4.0, 1.0])]  # the first is beyond the limit
    (tmp_path / "far").mkdir()
    assert {r.vec_id for r in _run(spark, tmp_path / "far", rows)} == {2, 3, 4}


def test_products_of_wide_integers_are_exact():
    rng = np.random.default_rng(5)
    for top in (1 << 10, 1 << 39):
        y = rng.integers(-top, top, (500, 4))
        assert (whitening._products(y) == y.astype(object).T @ y.astype(object)).all()


def _by_fractions(m):
    """Characteristic polynomial by the trace recursion, in exact fractions."""
    d = len(m)
    a = [[Fraction(x) for x in r] for r in m]
    c, b = [Fraction(1)], [[Fraction(i == j) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        ab = [[sum(a[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
        b = [[ab[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(x) for x in reversed(c)]


@pytest.mark.parametrize("d", [1, 2, 3, 7])
def test_polynomial_equals_the_one_by_fractions(spark, d):
    rnd = random.Random(d)
    g = [[rnd.randrange(-10 ** 6, 10 ** 6) * (rnd.random() < 0.7) for _ in range(d)] for _ in range(d)]
    m = [[sum(g[t][i] * g[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
    whitening.ship_package(spark)
    assert whitening.characteristic_polynomial(spark, m) == _by_fractions(m)


def test_roots_are_counted_isolated_and_refined_exactly():
    roots = [3, 3, 10, 10, 10, 11, 4000]
    poly = [1]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    free = spectrum.square_free(poly)
    assert len(free) - 1 == 4
    assert [spectrum.roots_above(poly, a) for a in (0, 3, 9, 10, 3999, 4000)] == [7, 5, 5, 2, 1, 0]
    where = {1: (1, 1, 4000), 2: (2, 1, 11), 3: (3, 3, 10), 4: (3, 3, 10), 7: (6, 2, 3)}
    for k, (first, count, root) in where.items():
        low, high, bits, f, c = spectrum.isolate(poly, free, k)
        assert (f, c) == (first, count)
        assert spectrum.refine(free, low, high, bits, bits + 40) == root << (bits + 40)
    close = [2 ** 60 + 1, 2 ** 60]  # doubles can't tell them apart
    poly = [close[0] * close[1], -sum(close), 1]
    for k, root in enumerate(close, 1):
        low, high, bits, *_ = spectrum.isolate(poly, poly, k)
        assert spectrum.refine(poly, low, high, bits, bits + 8) == root << (bits + 8)


def test_vectors_of_eigenvalues_that_doubles_cannot_tell_apart():
    a, b = 3, 4  # axes (3, 4) / 5 and (-4, 3) / 5, eigenvalues 25 (t + 1) and 25 t
    t = 10 ** 18
    m = [[a * a * (t + 1) + b * b * t, a * b], [a * b, b * b * (t + 1) + a * a * t]]
    poly = [m[0][0] * m[1][1] - m[0][1] ** 2, -(m[0][0] + m[1][1]), 1]
    (_, value, axis), = spectrum.components(m, poly, poly, 1)
    assert axis == pytest.approx([0.6, 0.8], abs=1e-15) and abs(value - 25 * (t + 1)) < Fraction(1, 10 ** 20)
    (_, _, axis), = spectrum.components(m, poly, poly, 2)
    assert axis == pytest.approx([0.8, -0.6], abs=1e-15)
