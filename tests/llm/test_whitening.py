import math

import numpy as np
import pytest

from reedline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, length string, component string, total string, i string, j string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["?"] * 6) for i, v in rows], SCHEMA).repartition(3)


def check(spark, rows, d, **more):
    """All columns against numpy's own decomposition and exact integers; returns the rows."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(16, d)
    out = whitening.whiten(spark, table(spark, rows), **more).collect()
    assert len(out) == m * len(kept) and {r.n for r in out} == {n}
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    sign = {}
    for i, x in kept:
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(x, s))
        for k in range(m):
            for r in by_id[i][k + 1]:
                assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
                if len(by_id[i][k + 1]) == 1:
                    want = (np.array(x) - s / n) @ vectors[:, k] / np.sqrt(values[k])
                    turn = sign.setdefault(k, 1.0 if abs(r.whitened - want) <= abs(r.whitened + want) else -1.0) if abs(want) > 1e-3 else sign.get(k)
                    assert r.deviation == deviation
                    if turn:
                        assert r.whitened == pytest.approx(turn * want, abs=1e-6)
    assert all(r.identity_error <= 1e-9 for r in out) and len({r.identity_error for r in out}) == 1
    return out


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (400, 20)) * np.linspace(3, 0.2, 20)
    rows = [(i, v) for i, v in enumerate(base.tolist())] + [(1000 + i, base[0].tolist()) for i in range(200)]  # a third are copies
    rows += [(2000, None), (2001, []), (2002, [1.0] * 19), (2003, [float("nan")] * 20), (2004, [None] * 20), (2005, [float("inf")] * 20), (None, base[1].tolist())]
    check(spark, rows, 20)


def test_few_dimensions_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 40, v) for i, v in enumerate(rng.normal(0, 2, (60, 3)).tolist())]
    out = whitening.whiten(spark, table(spark, rows)).collect()
    assert len(out) == 180 and max(r.component for r in out) == 3
    w = np.array([[r.whitened for r in out if r.component == k + 1] for k in range(3)])
    assert np.cov(w, bias=True) == pytest.approx(np.eye(3), abs=1e-9)


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(spark, table(spark, [])).count() == 0
    assert whitening.whiten(spark, table(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(spark, table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whitening.whiten(spark, table(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(9)])).collect()  # one direction only
    assert {r.component for r in line if r.whitened is not None} == {1} and max(r.explained for r in line) == pytest.approx(1.0)
    far = whitening.whiten(spark, table(spark, [(1, [3e38, 1.0]), (2, [1.0, 2.0]), (3, [1.5, 2.0])])).collect()
    assert {r.vec_id for r in far} == {2, 3}


def test_jacobi_keeps_small_eigenvalues():
    d = 12
    scale = 10.0 ** -np.arange(d)
    core = np.eye(d) + 0.1
    values, vectors = whitening.jacobi(core * np.outer(scale, scale))
    assert np.prod(values / scale**2) == pytest.approx(1 + 0.1 * d, rel=1e-11)  # the determinant, over 22 decades
    assert vectors.T @ vectors == pytest.approx(np.eye(d), abs=1e-13)
    again, _ = whitening.jacobi(np.diag([1.0, 3.0, 3.0, 0.0]))
    assert again.tolist() == [3.0, 3.0, 1.0, 0.0]


def test_scatter_is_exact_beyond_floats():
    y = np.array([[3, 1 << 30], [1 << 30, -1], [1, 1]])
    assert whitening._exact_scatter(y).tolist() == [[9 + (1 << 60) + 1, (3 << 30) - (1 << 30) + 1], [(3 << 30) - (1 << 30) + 1, (1 << 60) + 2]]
    assert whitening._deviations(np.array([[1 << 40, 0]]), 1 << 20, [0, 0]) == [None]
