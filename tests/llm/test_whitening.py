from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from verdance.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def brute(rows, most=16):
    """Exact integer sums and covariance, eigenvalues by another routine."""
    kept = []
    for k, v, *_ in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((k, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)))
    size: dict = {}
    for _, x in kept:
        size[len(x)] = size.get(len(x), 0) + 1
    d = min(size, key=lambda s: (-size[s], s))
    kept = [(k, x) for k, x in kept if len(x) == d]
    fit = sorted({x for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    cov = [[float(sum(Fraction((n * x[i] - total[i]) * (n * x[j] - total[j]), n * n) for x in fit) / n) for j in range(d)] for i in range(d)]
    e = np.sort(np.linalg.eigvalsh(np.array(cov)))[::-1]
    return kept, n, total, np.array(cov), e[: min(most, d)], np.trace(np.array(cov))


def vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    basis = rng.normal(size=(d, d)) * np.geomspace(0.5, 0.02, d)[:, None]
    return (rng.normal(size=(n, d)) @ basis).astype(np.float32)


def test_jacobi_against_a_library_routine():
    for d in (1, 2, 5, 40):
        a = vectors(80, d, d)
        m = (a.T @ a).astype(float)
        e, v = whitening.jacobi(m)
        assert np.allclose(e, np.sort(np.linalg.eigvalsh(m))[::-1], rtol=1e-9, atol=1e-9) and np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(m @ v, v * e, atol=1e-11 * max(1, e[0]))
    # small eigenvalues of a graded matrix keep their relative accuracy: known from the inverse, which is exact here
    g = np.diag([1.0, 1e-8, 1e-16]) + 0.0
    g[0, 1] = g[1, 0] = 1e-5
    e, _ = whitening.jacobi(g)
    assert e[1] == pytest.approx(1e-8 - 1e-10, rel=1e-9) and e[2] == pytest.approx(1e-16, rel=1e-12)


@pytest.mark.parametrize(("n", "d"), [(60, 5), (90, 20)])
def test_equals_brute_force(spark, n, d):
    a = vectors(n, d)
    rows = [(k, [float(c) for c in v], k % 3, "x", "n") for k, v in enumerate(a)]
    rows += [rows[4], rows[4], (None, rows[5][1], 1, None, None), (900, None, 1, "", ""), (901, [], 1, "", ""), (902, [*rows[0][1][:-1], None], 1, "", ""), (903, [float("nan")] * d, 1, "", ""), (904, [float("inf")] * d, 1, "", ""), (905, [0.5] * (d + 1), 1, "", ""), (906, [2.0**60] * d, 1, "", "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    usable = [r for r in rows if r[0] != 906]
    kept, count, total, cov, e, trace = brute(usable)
    k = min(16, d)
    assert len(got) == len(kept) * k and {r.n for r in got} == {count} and count < len(kept)
    dev = {}
    for key, x in kept:
        dev[key] = sum((count * c - s) ** 2 for c, s in zip(x, total, strict=True))
    by: dict = {}
    for r in got:
        assert r.deviation == dev[r.vec_id]
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
        by.setdefault(r.vec_id, {})[r.component] = r.whitened
    fit = {x: key for key, x in kept}
    z = np.array([[by[key][c] for c in range(1, k + 1)] for key in fit.values()])
    assert np.abs(z.T @ z / count - np.eye(k)).max() < 1e-9 and np.abs(z.mean(0)).max() < 1e-9
    x = np.array([[float(Fraction(count * c - s, count)) for c, s in zip(v, total, strict=True)] for v in fit], float)
    u = x.T @ z / count / np.sqrt(e)  # components, recovered
    assert np.allclose(cov @ u, u * e, atol=1e-8 * e[0]) and np.allclose(np.linalg.norm(u, axis=0), 1)


def test_degenerate_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.25, -0.5], 1, "", ""), (2, [0.25, -0.5], 1, "", "")], SCHEMA)).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0], 1, "", "") for k in range(5)], SCHEMA)).collect()
    first = [r for r in flat if r.component == 1]
    assert all(r.explained == pytest.approx(1) and r.identity_error < 1e-9 for r in first) and np.mean([r.whitened**2 for r in first]) == pytest.approx(1)
    assert all(r.whitened is None for r in flat if r.component > 1)


def test_whole_numbers_stay_exact_beyond_a_long(spark):
    rows = [(k, [float(c)], 1, "", "") for k, c in enumerate([0.0, 2.0**40, -(2.0**40)])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: None, 2: None}
