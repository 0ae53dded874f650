"""Whitening against numpy, over awkward rows."""

import numpy as np
import pytest

from tapeline.llm import whitening

VEC = "vec_id long, embedding array<float>, label int, x long, w double, c0 string"


def table(n=300, dim=20, seed=5):
    rng = np.random.default_rng(seed)
    base = (rng.standard_normal((n, dim)) @ rng.standard_normal((dim, dim)) * 0.3).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1, None, 1.0, "s") for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1], None, 3, None, None) for i in range(200)] + [(3, rows[3][1], 1, 1, 1.0, "s"), (None, rows[5][1], 1, 1, 1.0, "s")]
    bad = [None, [], [float("nan")] + [1.0] * (dim - 1), [1.0] * (dim - 1) + [float("-inf")], [None] + [1.0] * (dim - 1), [1.0] * (dim - 1), [1.0] * (dim + 1)]
    return rows + [(5000 + i, v, 1, 1, 1.0, "s") for i, v in enumerate(bad)]


def brute(rows, dim, most):
    """Rows of (vec_id, deviation, coordinates), with the share of each component."""
    good = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in good])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    white = (x - total / n) @ axes[:, :most] / np.sqrt(e[:most])
    off = [[n * int(c) - int(s) for c, s in zip(row, total, strict=True)] for row in x]
    return n, [(i, sum(c * c for c in o), w) for (i, _), o, w in zip(good, off, white, strict=True)], e[:most] / np.trace(v)


@pytest.mark.parametrize("most", [16, 3, 40])
def test_whiten(spark, most):
    rows = table()
    n, want, share = brute(rows, 20, most)
    got = {}
    for r in whitening.whiten(spark.createDataFrame(rows, VEC).repartition(5), most=most).collect():
        assert r.n == n and r.identity_error < 1e-9
        got.setdefault((r.vec_id, int(r.deviation)), []).append((r.component, r.whitened, r.explained))
    k = min(most, 20)
    assert sum(map(len, got.values())) == len(want) * k
    for i, deviation, white in want:
        own = sorted(got[i, deviation])
        assert [c for c, *_ in own][:: len(own) // k] == list(range(1, k + 1))
        own = own[:: len(own) // k]
        assert np.allclose(np.abs([w for _, w, _ in own]), np.abs(white), atol=1e-8)
        assert np.allclose([s for *_, s in own], share, rtol=1e-9)


def test_little_variance(spark):
    df = spark.createDataFrame(table(), VEC)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id in (5000, 5001, 5002)")).count() == 0
    one = whitening.whiten(df.where("vec_id in (7, 1000, 1001)")).collect()
    assert len(one) == 3 * 16 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    two = whitening.whiten(df.where("vec_id in (7, 8)")).collect()
    assert {abs(round(r.whitened, 9)) for r in two if r.component == 1} == {1.0} and {r.whitened for r in two if r.component > 1} == {None}
    assert two[0].identity_error < 1e-9


def test_exact_beyond_long(spark):
    """Deviations that no long holds stay exact."""
    far = [(0, [1e7, 0.0], 1, 1, 1.0, ""), (1, [-1e7, 5e8], 1, 1, 1.0, ""), (2, [3.0, -7e8], 1, 1, 1.0, "")]
    _, want, _ = brute(far, 2, 2)
    got = whitening.whiten(spark.createDataFrame(far, VEC)).where("component = 1").collect()
    assert {r.vec_id: int(r.deviation) for r in got} == {i: d for i, d, _ in want} and max(d for _, d, _ in want) > 1 << 63
