"""Fusion of a sparse fine stack with a dense coarse one: fine residuals carried to a day by distance in time and to clouds.

A pixel's days are one array, so every pixel and day is shuffled once, whatever the number of target days, layers, widths and
runs. Weights in time depend on the days alone: pixels that share their days share one matrix of them, and a pixel's prediction
of all days, layers and runs is a product with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DAYS, SATURATION = 30, 15.0
_PIXELS = 64  # pixels whose predictions a task holds before it passes them on
_MATRICES = 16


def clearness(distance: Column) -> Column:
    """Rises with the distance to clouds from 0 at 1 to full at 16; full without clouds."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(distance, F.lit(float("inf"))) - 1) / SATURATION))


def _day(date: Column | str) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def fuse_layers(high: DataFrame, low: DataFrame, targets: DataFrame, keys: list[str], layers: list[str], runs: dict[str, Column], max_days: int = MAX_DAYS) -> DataFrame:
    """Prediction of each pixel at each target day, by run and width: low(t) + weighted mean of (high - low) over acquisitions within max_days.

    high(keys, row, col, date, layers, distance) and low(keys, row, col, date, layers) share a grid, low with one row a pixel and
    day; targets(keys, date, sigma). `runs` names conditions on high's rows: a run counts the rows that meet its condition.
    Returns (keys, row, col, date, run, sigma, n_<layer>, <layer>): n counts the acquisitions in reach, which need a coarse value
    of their own day. A layer is null where all weights are 0 or low(t) is missing; days without an acquisition in reach for any
    layer have no row.
    """
    cell, named = [*keys, "row", "col"], list(runs)
    value = lambda: [F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(layers)]
    used = [F.coalesce(c, F.lit(False)).alias(f"u{k}") for k, c in enumerate(runs.values())]
    fine = high.select(*cell, F.struct(_day("date").alias("d"), F.lit(True).alias("fine"), clearness(F.col("distance")).alias("w"), *used, *value()).alias("_i"))
    coarse = low.select(*cell, F.struct(_day("date").alias("d"), F.lit(False).alias("fine"), F.lit(0.0).alias("w"), *[F.lit(False).alias(f"u{k}") for k in range(len(named))], *value()).alias("_i"))
    packed = fine.unionByName(coarse).groupBy(*cell).agg(F.collect_list("_i").alias("_i"))
    wanted = targets.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(_day("date").alias("d"), F.col("sigma").cast("double").alias("s")))).alias("_t"))
    kinds = [f"{k} {packed.schema[k].dataType.simpleString()}" for k in cell]
    schema = ", ".join([*kinds, "date date", "run string", "sigma int", *[f"n_{c} long" for c in layers], *[f"{c} double" for c in layers]])
    return packed.join(wanted, keys).select(*cell, "_i", "_t").mapInArrow(_predict(len(cell), layers, named, max_days), schema)


def _predict(n_keys: int, layers: list[str], runs: list[str], max_days: int):
    def numbers(a: pa.Array) -> np.ndarray:
        return a.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            items, wanted = b.column(n_keys), b.column(n_keys + 1)
            at, to = (a.offsets.to_numpy() - a.offsets[0].as_py() for a in (items, wanted))
            flat, target = items.flatten(), wanted.flatten()
            day, is_fine, clear = (numbers(flat.field(k)) for k in ("d", "fine", "w"))
            use = np.column_stack([numbers(flat.field(f"u{k}")) for k in range(len(runs))])
            value = np.column_stack([numbers(flat.field(f"v{k}")).astype(float) for k in range(len(layers))])
            t_day, t_sigma = numbers(target.field("d")), numbers(target.field("s"))
            for first in range(0, b.num_rows, _PIXELS):
                out: list[tuple] = []
                for p in range(first, min(first + _PIXELS, b.num_rows)):
                    own, goal = slice(at[p], at[p + 1]), slice(to[p], to[p + 1])
                    f, d, v = is_fine[own], day[own], value[own]
                    low_at = np.argsort(d[~f], kind="stable")
                    low_day, low = d[~f][low_at], v[~f][low_at]

                    def coarse(days: np.ndarray, low_day=low_day, low=low) -> np.ndarray:
                        found = np.full((len(days), len(layers)), np.nan)
                        place = np.searchsorted(low_day, days)
                        there = place < len(low_day)
                        there[there] = low_day[place[there]] == days[there]
                        found[there] = low[place[there]]
                        return found

                    high_day, td, ts = d[f], t_day[goal], t_sigma[goal]
                    residual = v[f] - coarse(high_day)
                    name = (high_day.tobytes(), td.tobytes(), ts.tobytes())
                    if name not in matrices:
                        while len(matrices) >= _MATRICES:
                            matrices.pop(next(iter(matrices)))
                        away = (high_day[None, :] - td[:, None]).astype(float)
                        near = np.abs(away) <= max_days
                        matrices[name] = near.astype(float), np.where(near, np.exp(-(away * away) / (2.0 * ts * ts)[:, None]), 0.0)
                    near, weights = matrices[name]
                    base, known = coarse(td), ~np.isnan(residual)
                    for r in range(len(runs)):
                        counts = known & use[own][f][:, r : r + 1]
                        w = counts * clear[own][f][:, None]
                        total = weights @ w
                        mean = np.divide(weights @ (w * np.where(counts, residual, 0.0)), total, out=np.full(total.shape, np.nan), where=total > 0)
                        n = np.rint(near @ counts).astype(np.int64)
                        some = np.flatnonzero(n.max(1, initial=0) > 0)
                        out.append((p, r, td[some], ts[some], n[some], (base + mean)[some]))
                yield _rows(b, n_keys, layers, runs, out)

    return run


def _rows(b: pa.RecordBatch, n_keys: int, layers: list[str], runs: list[str], out: list[tuple]) -> pa.RecordBatch:
    each = [len(o[2]) for o in out]
    pixel, run = (pa.array(np.repeat([o[k] for o in out], each)) for k in range(2))
    days, sigmas, n, fused = (np.concatenate([o[k] for o in out]) for k in range(2, 6))
    columns = [b.column(k).take(pixel) for k in range(n_keys)]
    columns += [pa.array(days.astype(np.int32)).cast(pa.date32()), pa.array(runs).take(run), pa.array(sigmas.astype(np.int32))]
    columns += [pa.array(n[:, k]) for k in range(len(layers))] + [pa.array(fused[:, k], mask=np.isnan(fused[:, k])) for k in range(len(layers))]
    names = [*b.schema.names[:n_keys], "date", "run", "sigma", *[f"n_{c}" for c in layers], *layers]
    return pa.RecordBatch.from_arrays(columns, names=names)


def fuse(high: DataFrame, low: DataFrame, targets: DataFrame, keys: list[str], max_days: int = MAX_DAYS) -> DataFrame:
    """fuse_layers of the one layer `value` with every acquisition: (keys, row, col, date, sigma, n_acquisitions, fused)."""
    out = fuse_layers(high, low, targets, keys, ["value"], {"all": F.lit(True)}, max_days)
    return out.select(*keys, "row", "col", "date", "sigma", F.col("n_value").alias("n_acquisitions"), F.col("value").alias("fused"))
