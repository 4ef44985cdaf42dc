"""Whitening against numpy in high precision, clustered eigenvalues, exact deviations, odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tests.llm.conftest import SF
from tracksift.llm import whitening
from tracksift.llm.queries import op11_whitening

NAN, INF = float("nan"), float("inf")


def symmetric(rng, values):
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 100, 64),
        np.r_[5 + np.arange(32) * 1e-9, np.arange(32) * 10.0 + 20],  # 32 values that float32 can't tell apart
        1 + np.arange(20) * 1e-10,  # all of them
        np.r_[1e6, np.arange(10) * 1e-6 + 1, np.arange(10) * 1e-6 + 7],
        np.r_[np.zeros(40), np.arange(24) + 1.0],
        np.geomspace(1e-12, 1e6, 64),
        np.ones(1),
    ],
)
def test_eigen_in_clusters(values):
    a = symmetric(np.random.default_rng(1), values)
    got, x = whitening.eigen(a)
    want = np.linalg.eigvalsh(a)[::-1]
    top = np.abs(want).max()
    assert np.abs(got - want).max() < 1e-14 * top
    assert np.abs(a @ x - x * got).max() < 1e-14 * top
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-12


def test_float32_alone_is_not_enough():
    a = symmetric(np.random.default_rng(1), np.r_[5 + np.arange(32) * 1e-9, np.arange(32) * 10.0 + 20])
    v, x = np.linalg.eigh(a.astype(np.float32))
    assert np.abs(a @ x - x * v).max() > 1e-9 * v.max()


def test_zero_and_diagonal_matrices():
    v, x = whitening.eigen(np.zeros((3, 3)))
    assert v.tolist() == [0, 0, 0] and np.array_equal(x, np.eye(3))
    v, x = whitening.eigen(np.diag([1.0, 3.0, 2.0]))
    assert v.tolist() == [3, 2, 1]


def brute(vectors):
    """Rows kept, and the same numbers by numpy on the distinct integer vectors."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit], np.longdouble)
    v = (z.T @ z / n).astype(np.float64)
    e, p = np.linalg.eigh(v)
    return kept, n, sums, e[::-1], p[:, ::-1], float(np.trace(v))


def compare(rows, vectors, k):
    kept, n, sums, e, p, trace = brute(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == len(kept) * k and set(by) == {i for i, _ in kept}
    signs = None
    for i, x in kept:
        z = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        want = z @ p[:, :k] / np.sqrt(e[:k])
        got = np.array([by[i][j + 1].whitened for j in range(k)])
        if signs is None:
            signs = np.sign(want * got)
        assert np.abs(want * signs - got).max() < 1e-9
        for j in range(k):
            r = by[i][j + 1]
            assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
            assert abs(r.explained - e[j] / trace) < 1e-12 and r.identity_error < 1e-9


def test_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(op11_whitening(spark, SF).collect(), vectors, 16)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = [[float(np.float32(c)) for c in rng.normal(size=3) * 5] for _ in range(40)]
    rows = [(i, v, "a", 1) for i, v in enumerate(good)]
    rows += [(100, good[0], None, 1), (100, good[0], None, 1), (None, good[1], "b", None)]  # repeats count once in the fit
    rows += [(200, None, "c", 2), (201, [1.0, None, 2.0], "c", 2), (202, [1.0, NAN, 2.0], "c", 2), (203, [INF, 0.0, 0.0], "c", 2)]
    rows += [(300, [1.0, 2.0], "c", 2), (301, [], "c", 2), (302, [1e30, 0.0, 0.0], "c", 2)]
    schema = "vec_id long, embedding array<float>, whitened string, n int"
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted([(False, i) for i in range(40)] + [(False, 100)] * 2 + [(True, 0)])
    assert all(r.n == 40 and len(r.whitened) == 3 for r in got)
    one = {r.vec_id: r for r in got}
    assert one[100].whitened == one[0].whitened and one[100].deviation == one[0].deviation
    df.createOrReplaceTempView("odd")
    path = str(tmp_path / "sf")
    df.where("vec_id < 100").write.parquet(f"{path}/embeddings.parquet")
    compare(op11_whitening(spark, path).collect(), [(i, v) for i, v, _, _ in rows if i is not None and i < 100], 3)
    for few in ([], [(1, None, "", 1)], [(1, [], "", 1)]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, [], [], 0.0)] * 2


def test_a_constant_dimension_and_large_entries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), 7.0, float(a) * 2, float(b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, size=(60, 2)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert all(len(r.whitened) == 2 and r.identity_error < 1e-9 for r in got)  # two of four dimensions carry all variance
    huge = spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0]), (3, [4e15, 5.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in whitening.whiten(huge).collect()}
    assert got[1].n == 3 and all(r.deviation is None for r in got.values())  # over a long
    assert whitening.whiten(huge).first().identity_error < 1e-6
