"""Whitening against dense eigenvectors, exact deviations, inertia counts and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} by dense linear algebra and whole numbers."""
    keep = [(k, [math.floor(256 * c) for c in v]) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fits = sorted({tuple(x) for _, x in keep})
    n, sums = len(fits), [sum(c) for c in zip(*fits, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fits])
    v = centred.T @ centred / n
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:4], p[:, ::-1][:, :4]
    out = []
    for k, x in keep:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        w = np.array([o / n for o in off]) @ p / np.sqrt(e)
        out += [(k, i + 1, n, sum(o * o for o in off), abs(w[i]), e[i] / np.trace(v)) for i in range(len(e))]
    return out


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "size", "n", "at")})
    return wh.whiten(df.repartition(parts)).collect()


def check(found, want):
    def key(r):
        return str(r[0]), r[1], r[3], r[4]

    found = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("seed, size, shift", [(0, 6, 0.0), (1, 24, 1e6), (2, 4, -3.0)])
def test_equals_dense_eigenvectors(spark, seed, size, shift):
    r = np.random.default_rng(seed)
    spread = 3.0 ** -np.arange(size).clip(max=8)
    rows = [(i, (shift + r.standard_normal(size) * spread).tolist()) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 260)]  # a common vector counts once
    found = run(spark, rows)
    check(found, brute(rows))
    assert max(r.identity_error for r in found) < 1e-8 and len({r.identity_error for r in found}) == 1


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(3).tolist()) for i in range(40)]
    odd = [(90, None), (91, [1.0, None, 2.0]), (92, [math.nan, 0.0, 0.0]), (93, [math.inf, 0.0, 0.0]), (94, []),
           (None, rows[3][1]), (5, rows[7][1]), (95, [-0.0, 0.0, 0.0])]
    fine = rows + [odd[5], odd[6], odd[7]]
    check(run(spark, rows + odd), brute(fine))  # three dimensions give three components
    assert run(spark, []) == [] and run(spark, odd[:5]) == [] and run(spark, [(1, [1.0, 2.0])] * 3) == []


def test_lengths_apart_and_directions_without_variance(spark):
    r = np.random.default_rng(6)
    three = [(i, r.standard_normal(3).tolist()) for i in range(30)]
    flat = [(100 + i, [float(i), 2.0 * i, 7.0, 0.5 * i, -i / 4]) for i in range(20)]
    found = run(spark, three + flat)
    check([x for x in found if x.vec_id < 100], brute(three))
    line = [x for x in found if x.vec_id >= 100]
    assert {x.component for x in line} == {1} and len(line) == 20
    check(line, [x for x in brute(flat) if x[1] == 1])


def test_numbers_beyond_64_bits(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    found = run(spark, rows)
    assert {x.vec_id for x in found} == {1, 2, 3} and all(math.isfinite(x.whitened) for x in found)
    assert {x.deviation for x in found if x.vec_id < 3} == {None}


def test_large_counts_are_exact():
    fit = wh.Fit(10**7, [10**7 * 5 + 3, -(10**16) + 1])
    x = np.array([[6, -(10**9)], [2**40, 0]], np.int64)
    want = [(10**7 * 6 - 10**7 * 5 - 3) ** 2 + (-(10**16) + 10**16 - 1) ** 2, None]
    assert fit.deviations(x).to_pylist() == want


@pytest.mark.parametrize("seed", range(4))
def test_inertia(seed):
    r = np.random.default_rng(seed)
    a = r.standard_normal((9, 9))
    a = a + a.T if seed % 2 else np.diag([3.0, 3, 3, 1, 0, 0, -1, -2, -2])
    values = np.linalg.eigvalsh(a)
    for s in (-5.0, -0.5, 0.5, 2.0, 2.999, 9.0):
        assert wh.above(a, s) == (values > s).sum()


def test_equal_eigenvalues(spark):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((12, 12)))[0]
    v = q @ np.diag([9.0, 5, 5, 5, 5, 5, 1, 1, 1, 0, 0, 0]) @ q.T
    values, vectors = wh.leading(spark, (v + v.T) / 2, 4)
    assert np.allclose(values, [9, 5, 5, 5]) and np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-12)
