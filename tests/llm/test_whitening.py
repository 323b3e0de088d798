"""Whitening: exact bit-sliced products, the fit against Fractions, edge cases."""

import random
from fractions import Fraction

import numpy as np
import pytest

from panelflow.llm import whitening as W
from tests.conftest import SF


def test_cross_products_are_exact():
    rnd = np.random.default_rng(3)
    for rows, dims, low, high in ((1, 1, 0, 1), (63, 3, -5, 9), (64, 4, 10**6 - 40, 10**6 + 40), (777, 5, -2**40, 2**40), (300, 6, 7, 8)):
        x = rnd.integers(low, high, (rows, dims))
        s, g = W.cross_products(x)
        z = x.astype(object) - W.ORIGIN
        assert [int(v) for v in s] == [int(v) for v in z.sum(axis=0)]
        assert (g.astype(object) == z.T @ z).all()


def test_planes_give_the_numbers_back():
    y = np.random.default_rng(1).integers(0, 50, (130, 4))
    planes, dim, bit = W.bit_planes(y)
    got = np.zeros_like(y)
    for p, d, b in zip(planes, dim, bit, strict=True):
        got[:, d] += np.unpackbits(p.view(np.uint8))[:130].astype(int) << b
    assert (got == y).all()


def test_eigen_keeps_small_values_beside_large():
    rnd = np.random.default_rng(5)
    m = rnd.integers(-9, 10, (6, 6)) * np.array([10**6, 1, 1, 1, 1, 1])[None, :]
    g = [[int(v) for v in row] for row in m.T.astype(object) @ m.astype(object)]
    lam, q = W.eigen(g, 1)
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-14
    for k in range(6):      # residual of the exact matrix
        v = [Fraction(float(x)) for x in q[:, k]]
        gv = [sum(Fraction(a) * b for a, b in zip(row, v, strict=True)) for row in g]
        quotient = float(sum(a * b for a, b in zip(v, gv, strict=True)))
        assert lam[k] == pytest.approx(quotient, rel=1e-3 if lam[k] < 1e-9 * lam[0] else 1e-9)
    det = np.prod([Fraction(float(x)) for x in lam])
    assert float(det) == pytest.approx(round(float(np.linalg.det(m.astype(float)))) ** 2, rel=1e-5)


def rows_of(spark, rows, schema="vec_id long, embedding array<float>"):
    return W.whiten(spark.createDataFrame(rows, schema)).collect()


def test_against_brute_force(spark):
    rnd = random.Random(9)
    base = [[rnd.gauss(0, 1) for _ in range(5)] for _ in range(90)]
    for v in base:
        v[1] += v[0]
    rows = [(i, v) for i, v in enumerate(base)] + [(500 + i, base[7]) for i in range(40)]        # copies count once
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, []), (None, base[3])]
    got = rows_of(spark, rows + bad)
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == sorted(i for i, _ in rows) and len(got) == len(rows) + 1
    f = np.array(base, np.float32).astype(np.float64)
    x = np.unique(np.floor(64 * f).astype(np.int64) + W.ORIGIN, axis=0)
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T, ddof=0)
    lam, q = np.linalg.eigh(v)
    lam, q = lam[::-1], q[:, ::-1]
    by = {r.vec_id: r for r in got}
    signs = None
    for i, e in rows:
        own = np.floor(64 * np.array(e, np.float32).astype(np.float64)).astype(np.int64) + W.ORIGIN
        r = by[i]
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s, strict=True))
        want = (own - s / n) @ q / np.sqrt(lam)
        signs = np.sign(want * r.whitened) if signs is None else signs
        assert np.allclose(want * signs, r.whitened, atol=1e-6)
        assert np.allclose(r.explained, lam / lam.sum()) and r.identity_error < 1e-9


def test_edges(spark):
    assert rows_of(spark, []) == []
    same = rows_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(1, 0, [])] * 2
    # a constant dimension has no component; lengths are fitted apart; large entries stay exact
    mixed = rows_of(spark, [(1, [1.0, 3.0]), (2, [2.0, 3.0]), (3, [4.0, 3.0]), (4, [1.0]), (5, [2.0]), (6, [1e30, 0.0])])
    assert {r.vec_id: (r.n, len(r.whitened)) for r in mixed} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (2, 1), 5: (2, 1)}
    assert max(r.identity_error for r in mixed) < 1e-9
    big = rows_of(spark, [(1, [1e9]), (2, [-1e9]), (3, [0.0])])
    assert {r.vec_id: r.deviation for r in big}[1] is None or all(r.identity_error < 1e-9 for r in big)


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5, "a"), (2, [2.0, 5.0], 6, "b"), (3, [0.0, 1.0], 6, "b")],
                               "vec_id long, embedding array<double>, x int, whitened string")
    assert W.whiten(df).count() == 3
    assert "x" in W.whiten(df, keep=("vec_id", "x")).columns


def test_query(spark):
    got = W.op11_whitening(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len(got) == 16 * n and {r.component for r in got} == set(range(1, 17))
    assert max(r.identity_error for r in got) < 1e-4
    one = [r.explained for r in sorted(got, key=lambda r: (r.vec_id, r.component))[:16]]
    assert one == sorted(one, reverse=True)
