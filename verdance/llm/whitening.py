"""Whitening of embeddings by a cyclic Jacobi eigendecomposition of their covariance.

Components of a vector become whole numbers, so that counts and sums over the distinct vectors are exact and each vector is
centred exactly before anything is multiplied. Tasks add up the centred scatter of their vectors; the driver gets one matrix of
the vectors' dimension, rotates its off-diagonal entries away in cyclic order and broadcasts the matrix that whitens. Rotations
stop at entries that are small against both their diagonal entries, which keeps small eigenvalues accurate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, SHIFT, MOST = 64, 1_000_000, 16
LARGEST = 2.0**56  # entries of this size or more have no whole number
_MAX = 2**63 - 1


def jacobi(a: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, each with its largest entry positive."""
    a, d = np.array(a, float), len(a)
    v, tiny = np.eye(d), np.finfo(float).eps
    for _ in range(most_sweeps):
        rotated = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                if abs(off) <= tiny * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])) or abs(off) < np.finfo(float).tiny:
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.copysign(1.0, theta) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                at_p, at_q = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[:, p], a[q], a[:, q] = row_p, row_p, row_q, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = at_p, at_q, 0.0, 0.0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not rotated:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    e, v = e[order], v[:, order]
    return e, v * np.where(v[np.abs(v).argmax(0), range(d)] < 0, -1.0, 1.0) if d else v


@dataclass(frozen=True)
class Model:
    """n vectors with sums `total` of `d` dimensions; `weights` (d x components) whitens what is centred, nan where an eigenvalue is 0."""

    n: int
    total: list[int]
    values: np.ndarray
    explained: np.ndarray
    weights: np.ndarray
    error: float


def whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Not null or empty, and with neither nulls nor entries that are not finite or too large for whole numbers (2^50 and more)."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exact: 64-bit where it fits, else Python's whole numbers."""
    most = int(np.abs(x).max(initial=0))
    if n * most < 2**62 and max(map(abs, total)) < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _squares(dev: np.ndarray) -> list[int | None]:
    """Sums of squares by row; null beyond a long."""
    most = int(np.abs(dev).max(initial=0))
    if dev.dtype != object and dev.shape[1] * most * most <= _MAX:
        return (dev * dev).sum(1).tolist()
    sums = (dev.astype(object) ** 2).sum(1).tolist()
    return [int(s) if s <= _MAX else None for s in sums]


def _centred(dev: np.ndarray, n: int) -> np.ndarray:
    return dev.astype(float) / n


def fit(vectors: DataFrame, d: int, components: int = MOST) -> Model | None:
    """The model of vectors(x), whole numbers in d dimensions, each distinct one counting once; None without vectors.

    Distinct vectors meet by partial aggregation. What reaches the driver is d sums, d x d entries and components^2 entries.
    """
    distinct = cut(vectors.distinct())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for b in batches:
            x = _matrix(b.column(0), d)
            exact = int(np.abs(x).max(initial=0)) * max(len(x), 1) < 2**62
            n, total = n + len(x), total + (x.sum(0) if exact else x.astype(object).sum(0))
        yield pa.RecordBatch.from_pydict({"k": list(range(-1, d)), "v": [str(int(t)) for t in (n, *total)]}, schema=pa.schema([("k", pa.int32()), ("v", pa.string())]))

    rows = distinct.mapInArrow(sums, "k int, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    found = {r.k: int(r.v) for r in rows}
    n = found.get(-1, 0)
    if not n:
        return None
    total = [found[k] for k in range(d)]

    def added_up(width: int, of_batch) -> np.ndarray:
        """The sum over all batches of a matrix of `width` columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                m = of_batch(_centred(_deviations(_matrix(b.column(0), d), n, total), n))
                out = m if out is None else out + m
            if out is not None:
                yield pa.RecordBatch.from_pydict({"i": list(range(len(out))), "v": out.tolist()}, schema=pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64()))]))

        cells = distinct.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((max(r.i for r in cells) + 1, width))
        for r in cells:
            out[r.i, r.j] = r.v
        return out

    covariance = added_up(d, lambda z: z.T @ z) / n
    covariance = (covariance + covariance.T) / 2
    e, v = jacobi(covariance)
    trace = float(np.trace(covariance))
    k = min(components, d)
    real = e[:k] > d * np.finfo(float).eps * max(trace, 0.0)
    weights = np.where(real, v[:, :k] / np.sqrt(np.where(real, e[:k], 1.0)), np.nan)
    explained = e[:k] / trace if trace > 0 else np.full(k, np.nan)
    error = float("nan")
    if real.any():
        w = weights[:, real]
        m = added_up(w.shape[1], lambda z: np.vstack([(z @ w).T @ (z @ w), (z @ w).sum(0)])) / n
        mean = m[-1]
        error = float(np.abs(m[:-1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return Model(n, total, e[:k], explained, weights, error)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = MOST) -> DataFrame:
    """One row per usable row of `rows` and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is not usable are dropped, and so are those of another dimension than most usable ones have (the smaller of
    equals). Repeated rows each get theirs. Components with an eigenvalue of 0 (fewer distinct vectors than dimensions, or constant
    ones) have a null `whitened` and don't count in identity_error; explained is null where nothing varies. deviation is null
    beyond a long. Ids may be of any type and null; other columns are not read. An empty table gives no rows.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v"))).select("id", whole(F.col("v")).alias("x"))
    common = held.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = common.d if common else 1
    held = held.filter(F.size("x") == d)
    model = fit(held.select("x"), d, components)
    kind = held.schema["id"].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return held.limit(0).select("id", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in out.split(", ")[1:])]).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = m.weights.shape[1]
        null = lambda a: pa.array(a, pa.float64(), mask=np.isnan(a))
        for b in batches:
            dev = _deviations(_matrix(b.column(1), d), m.n, m.total)
            z, size = _centred(dev, m.n) @ m.weights, b.num_rows
            each = pa.array(np.repeat(np.arange(size), k))
            columns = {
                "id": b.column(0).take(each), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), "n": pa.array(np.full(size * k, m.n)), "deviation": pa.array(_squares(dev), pa.int64()).take(each),
                "whitened": null(z.reshape(-1)), "explained": null(np.tile(m.explained, size)), "identity_error": null(np.full(size * k, m.error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return held.mapInArrow(apply, out).withColumnRenamed("id", id_col)
