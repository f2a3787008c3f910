"""Smoothing of series: moving averages over composites, and the Whittaker smoother."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAMBDA, LEAST_DAYS = 400.0, 3
CELLS = 2_000_000  # days x series that a task solves at once


def moving_average(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 5, nodata: float = 0.0) -> DataFrame:
    """`smoothed`: the mean of the known values of the `width` composites about a row, cut at the ends; nodata where there are none.

    The frame counts rows, not days. A width of 1 or less leaves values as they are.
    """
    known = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) != nodata), F.col(value))
    if width <= 1:
        return rows.withColumn("smoothed", F.coalesce(known, F.lit(nodata)))
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return rows.withColumn("smoothed", F.coalesce(F.avg(known).over(near), F.lit(nodata)))


def solve_whittaker(weights: np.ndarray, values: np.ndarray, lam: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """The z of least weighted squared error plus lam times squared second differences, of one series or of one a column.

    Series are days x series, of their own `sizes` (all days if None); what stands below a size is ignored. Every series is a
    pentadiagonal system; a sweep down and one up solve all of them together, a day at a time.
    """
    if values.ndim == 1:
        return solve_whittaker(weights[:, None], values[:, None], lam)[:, 0]
    n, m = values.shape
    size, i = np.full(m, n) if sizes is None else sizes, np.arange(n)[:, None]
    early, inner = i < size - 2, (i >= 1) & (i <= size - 2)
    a = np.where(i < size, weights + lam * (early + 4.0 * inner + ((i >= 2) & (i < size))), 1.0)
    e, f = -2.0 * lam * (early.astype(float) + inner), lam * early
    z = np.where(i < size, weights * values, 0.0)
    d, up, upper = np.empty((n, m)), np.empty((n, m)), np.empty((n, m))
    none = np.zeros(m)
    for k in range(n):
        d1, e1, f1, z1 = (d[k - 1], up[k - 1], upper[k - 1], z[k - 1]) if k else (none,) * 4
        d2, f2, z2 = (d[k - 2], upper[k - 2], z[k - 2]) if k > 1 else (none,) * 3
        d[k] = a[k] - d1 * e1 * e1 - d2 * f2 * f2
        up[k], upper[k] = (e[k] - d1 * e1 * f1) / d[k], f[k] / d[k]
        z[k] -= e1 * z1 + f2 * z2
    for k in range(n - 1, -1, -1):
        z[k] = z[k] / d[k] - (up[k] * z[k + 1] if k + 1 < n else 0.0) - (upper[k] * z[k + 2] if k + 2 < n else 0.0)
    return z


def whittaker(rows: DataFrame, keys: list[str], position: str = "pos", lam: float = LAMBDA, value: str = "value", day: str = "date") -> DataFrame:
    """Daily smoothed values between the first and last observed day of each key, the last row of a day winning.

    Null values are no observations; a key with fewer than two, or less than three days, gives no rows. A key's days are one
    array (one site's season or so), and a task solves its series many at a time.
    """
    number = F.datediff(day, F.lit("1970-01-01").cast("date"))
    seen = rows.filter(F.col(value).isNotNull()).groupBy(*keys, number.alias("_d")).agg(F.max_by(value, position).cast("double").alias("_v"))
    packed = seen.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_d", "_v"))).alias("_l")).filter((F.size("_l") >= 2) & (F.get("_l", F.size("_l") - 1)["_d"] - F.get("_l", F.lit(0))["_d"] + 1 >= LEAST_DAYS))
    kinds = [f"{k} {packed.schema[k].dataType.simpleString()}" for k in keys]
    return packed.mapInArrow(_smoothed(len(keys), day, lam), ", ".join([*kinds, f"{day} date", "smoothed double"]))


def _smoothed(n_keys: int, day: str, lam: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(n_keys)
            at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            d, v = flat.field("_d").to_numpy(), flat.field("_v").to_numpy()
            first = d[at[:-1]]
            size = d[at[1:] - 1] - first + 1
            order = np.argsort(-size, kind="stable")
            while len(order):
                some = order[: max(1, CELLS // int(size[order[0]]))]
                order = order[len(some) :]
                n, count = int(size[some[0]]), np.diff(at)[some]
                column = np.repeat(np.arange(len(some)), count)
                places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[some], count)
                w, y = np.zeros((n, len(some))), np.zeros((n, len(some)))
                row = d[places] - first[some][column]
                w[row, column], y[row, column] = 1.0, v[places]
                z = solve_whittaker(w, y, lam, size[some])
                inside = np.arange(n)[None, :] < size[some][:, None]
                each = pa.array(np.repeat(some, size[some]))
                days = (first[some][:, None] + np.arange(n))[inside].astype(np.int32)
                columns = [b.column(k).take(each) for k in range(n_keys)] + [pa.array(days).cast(pa.date32()), pa.array(z.T[inside])]
                yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:n_keys], day, "smoothed"])

    return run


def crossover(scores: DataFrame, keys: list[str], gap: str = "gap_days") -> DataFrame:
    """The shortest gap at which the fused score is strictly below the baseline's; null where there is none."""
    return scores.groupBy(*keys).agg(F.min(F.when(F.col("fusion") < F.col("baseline"), F.col(gap))).alias("crossover_days"))
