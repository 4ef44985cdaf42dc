"""Embedding whitening: principal components of a distributed covariance, by mixed-precision refinement.

Vectors become integers, and the fit list is each distinct one once. One pass counts it and sums its dimensions, the next
adds up centred products, each task its own matrix, and rows of these matrices are summed by Spark in two levels, so a
reducer holds the square root of the tasks' number of rows. What reaches the driver is one d x d matrix.

There, LAPACK's eigenvectors in float32 are the start. Ogita and Aishima's iteration corrects them by four matrix
products in float64 a step and converges quadratically, but not inside a cluster of eigenvalues closer than float32 tells apart. For
those, the covariance is projected on the cluster's span, less the cluster's mean value, and that small matrix, in which
float32 has its digits where the values differ, is solved the same way (and its own clusters again).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracksift.session import cut, ship

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Entries whose integer isn't within this have no exact long.
_LARGEST = float(1 << 61)
_ROUNDS = 12


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from nearby ones; within clusters, vectors become orthonormal only."""
    norm_a, last = np.linalg.norm(a, 2), np.inf
    values = np.zeros(len(a))
    for _ in range(_ROUNDS):
        r = np.eye(len(a)) - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else rounding, divided by a small gap, would turn vectors out of orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        close = 2 * (np.linalg.norm(s - np.diag(values), 2) + norm_a * np.linalg.norm(r, 2))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > close
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1.0), r / 2)
        x = x + x @ e
        size = float(np.abs(e).max(initial=0.0))
        if size <= np.finfo(np.float64).eps * 4 or size >= last / 2 and size < 1e-7:
            break
        last = size
    for _ in range(3):  # the last correction may have been large within what rounding allows: orthonormal again
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2
    return values, x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric float64 matrix."""
    d = len(a)
    if d <= 1 or not np.any(a - np.diag(np.diag(a))):
        order = np.argsort(-np.diag(a), kind="stable")
        return np.diag(a)[order], np.eye(d)[:, order]
    scale = float(np.abs(a).max())
    a = a / scale
    _, x = np.linalg.eigh(a.astype(np.float32))
    values, x = refine(a, x.astype(np.float64))
    # clusters: float32 mixes vectors of values that it can't tell apart, and so the iteration can't either
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    wide = np.finfo(np.float32).eps * d * float(np.abs(values).max())
    start = 0
    for stop in range(1, d + 1):
        if stop < d and values[stop - 1] - values[stop] <= wide:
            continue
        if 1 < stop - start < d:
            q, _ = np.linalg.qr(x[:, start:stop])
            mean = float(values[start:stop].mean())
            inner = q.T @ (a @ q - mean * q)
            inner_values, turn = eigen((inner + inner.T) / 2)
            x[:, start:stop] = q @ turn
            values[start:stop] = inner_values + mean
        elif stop - start == d:  # no value stands apart: less their mean, the differences show
            mean = float(values.mean())
            inner = a - mean * np.eye(d)
            if np.abs(inner).max() < 0.5 * np.abs(a).max():
                inner_values, x = eigen(inner)
                values = inner_values + mean
        start = stop
    values, x = refine(a, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x / np.linalg.norm(x, axis=0)


class Whitening(NamedTuple):
    """What was fitted: the list's length, each dimension's sum, eigenvalues above rounding, their vectors by column, and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n to a double's precision: the whole part is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null where that exceeds a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        y = x - whole
        most = max(int(np.abs(y).max(initial=0)), 1)
        if len(self.sums) * (self.n * (most + 1)) ** 2 < 1 << 62:
            z = self.n * y - rest
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * self.n - rest.astype(object)
        return [v if v < 1 << 63 else None for v in (int(v) for v in (z * z).sum(axis=1))]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def integers(vector: Column) -> Column:
    """Each entry as floor(64 c) + 1,000,000; null for a vector that is null or has an entry that is null, not finite, or too large for a long."""
    v = vector.cast("array<double>")
    # NaN counts as larger than any number
    whole = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) * SCALE < _LARGEST))
    return F.when(whole, F.transform(v, lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension: halves of 32 bits are added in tasks, and then as decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), d)
            low = (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.record_batch({"dim": pa.array(range(d), pa.int32()), "high": (x >> 32).sum(axis=0), "low": low, "n": pa.array([len(x)] * d, pa.int64())})

    parts = fit.select("x").mapInArrow(add, "dim int, high long, low long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = parts.groupBy("dim").agg(exact("high"), exact("low"), F.sum("n").alias("n")).orderBy("dim").collect()
    return rows[0].n, [int(r.high) * (1 << 32) + int(r.low) for r in rows]


def _products(frame: DataFrame, make, k: int) -> np.ndarray:
    """Sum over all rows of z^T z, for z = make(batch) with k columns: each task sums its own, rows of the sums meet in two levels."""
    lots = max(1, int(frame.rdd.getNumPartitions() ** 0.5))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((k, k))
        for b in batches:
            z = make(b)
            total += z.T @ z
        lot = TaskContext.get().partitionId() % lots
        yield pa.record_batch({"lot": pa.array([lot] * k, pa.int32()), "row": pa.array(range(k), pa.int32()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    def add(t: pa.Table) -> pa.Table:
        total = _matrix(t.column("sums").combine_chunks(), k).sum(axis=0)
        return pa.table({"lot": pa.array([0], pa.int32()), "row": t.column("row")[:1].combine_chunks(), "sums": pa.array([total], pa.list_(pa.float64()))})

    kind = "lot int, row int, sums array<double>"
    parts = frame.select("x").mapInArrow(own, kind)
    if lots > 1:
        parts = parts.groupBy("row", "lot").applyInArrow(add, kind)
    rows = parts.groupBy("row").applyInArrow(add, kind).collect()
    out = np.zeros((k, k))
    for r in rows:
        out[r.row] = r.sums
    return (out + out.T) / 2


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """Fitted on rows x (arrays of longs of one length), each distinct; with the largest error of the whitened list's covariance. None without rows."""
    first = vectors.first()
    if first is None or not len(first.x):
        return None
    ship(vectors.sparkSession)
    d = len(first.x)
    n, sums = _sums(vectors, d)
    base = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    v = _products(vectors, lambda b: base.centred(_matrix(b.column(0), d)), d) / n
    values, x = eigen(v)
    trace = float(np.trace(v))
    # values that rounding alone may have made aren't components
    real = int((values[:components] > d * np.finfo(np.float64).eps * max(float(values[0]), 0.0)).sum())
    fitted = Whitening(n, sums, values[:real], x[:, :real], trace)
    if not real:
        return fitted, 0.0
    got = _products(vectors, lambda b: fitted.whitened(_matrix(b.column(0), d)), real) / n
    return fitted, float(np.abs(got - np.eye(real)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each remaining row's id, n, deviation, whitened and explained (arrays by component) and identity_error.

    Dropped are rows whose vector is null or has a null or non-finite entry, or one of 2^61 / 64 or more, which has no exact long. Vectors need one
    length: where there are several, the one of most distinct vectors (of those, the longest) is kept and the other
    rows are dropped too. Repeated vectors count once in the fit and each get their row. A deviation over a long is
    null. Components whose eigenvalue is zero to a double's precision don't exist, so fewer than asked may come, and none (arrays are empty) if
    all vectors are equal. Null and repeated ids stay as they are; other columns don't matter. An empty table, or one of empty vectors, gives no rows.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).where("x is not null")
    fit_list = cut(own.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-fit")
    sizes = fit_list.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    found = fit(fit_list.where(F.size("x") == d), components) if d else None
    kind = own.schema["id"].dataType.simpleString()
    out = f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if found is None:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    fitted, error = found
    explained = (fitted.values / fitted.trace).tolist() if len(fitted.values) else []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), d)
            k = len(x)
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), pa.float64()))
            cols = {"id": b.column(0), "n": pa.array([fitted.n] * k, pa.int64()), "deviation": pa.array(fitted.deviations(x), pa.int64()), "whitened": lists(fitted.whitened(x))}
            yield pa.record_batch(cols | {"explained": lists(np.tile(explained, (k, 1))), "identity_error": pa.array([error] * k)})

    return own.where(F.size("x") == d).mapInArrow(each, out).withColumnRenamed("id", id_col)
