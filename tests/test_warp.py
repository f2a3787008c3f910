"""Warps between grids against a plain loop, the distance transform against brute force, and the fine stack that is made with both."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import products, raster, warp

GRID = "site int, zone int, x0 double, y0 double, dx double, dy double, height int, width int"


def grids(spark, *rows):
    return spark.createDataFrame(list(rows), GRID)


def kernel(x, kind):
    x = abs(x)
    if kind == "bilinear":
        return max(0.0, 1 - x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def plain(data, source, target, kind):
    """One zone: the weighted mean of all source cells, by the definition."""
    (_, _, x0, y0, dx, dy, h, w), (_, _, tx0, ty0, tdx, tdy, th, tw) = source, target
    wy, wx, out = max(1, tdy / dy), max(1, tdx / dx), {}
    for r in range(th):
        for c in range(tw):
            v, u = (y0 - (ty0 - (r + 0.5) * tdy)) / dy, (tx0 + (c + 0.5) * tdx - x0) / dx
            if not (0 <= v < h and 0 <= u < w):
                continue
            if kind == "nearest":
                out[r, c] = data.get((int(v), int(u)))
                continue
            some = [(kernel((i + 0.5 - v) / wy, kind) * kernel((j + 0.5 - u) / wx, kind), data.get((i, j))) for i in range(h) for j in range(w)]
            known = [(k, x) for k, x in some if x is not None and k]
            if any(k for k, _ in some):
                total = sum(k for k, _ in known)
                out[r, c] = sum(k * x for k, x in known) / total if known and total else None
    return out


@pytest.mark.parametrize("kind", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("target", [(1, 32, 103.0, 996.0, 7.0, 6.0, 8, 9), (1, 32, 95.0, 1010.0, 25.0, 17.0, 3, 4), (1, 32, 100.0, 1000.0, 10.0, 10.0, 6, 5), (1, 32, 5000.0, 1000.0, 10.0, 10.0, 2, 2)])
def test_equals_a_plain_loop(spark, kind, target):
    rng = np.random.default_rng(5)
    source = (1, 32, 100.0, 1000.0, 10.0, 10.0, 6, 5)
    data = {(r, c): None if rng.random() < 0.2 else float(rng.random()) for r in range(6) for c in range(5)}
    px = spark.createDataFrame([(1, 7, r, c, v if (r, c) != (2, 2) else float("nan"), 1.0) for (r, c), v in data.items()], "site int, scene int, row int, col int, v double, k double")
    data[2, 2] = None
    got = {(r.row, r.col): r for r in warp.warp(px, grids(spark, source), grids(spark, target), ["site"], ["site", "scene"], ["v", "k"], kind).collect()}
    want = plain(data, source, target, kind)
    assert got.keys() == want.keys()
    for at, v in want.items():
        assert (got[at].v is None) == (v is None) and (v is None or got[at].v == pytest.approx(v, abs=1e-9)) and got[at].k == pytest.approx(1.0)


def test_between_zones(spark):
    """A smooth field over longitude, read through a grid of the neighbouring zone, stays the field."""
    lon, lat = 12.0, 51.4
    place = spark.range(1).select(*raster.to_utm(F.lit(lon), F.lit(lat), 33)).first()
    other = spark.range(1).select(*raster.to_utm(F.lit(lon), F.lit(lat), 32)).first()
    fine = (1, 33, place[0] - 150, place[1] + 150, 10.0, 10.0, 30, 30)
    target = (1, 32, other[0] - 60, other[1] + 60, 8.0, 8.0, 15, 15)
    field = lambda name: warp.cells(grids(spark, *{"fine": [fine], "target": [target]}[name]), ["site"])
    zone = {"fine": 33, "target": 32}
    value = lambda name: field(name).withColumn("v", raster.to_lonlat(F.col("x"), F.col("y"), zone[name])[0] * 1000 + raster.to_lonlat(F.col("x"), F.col("y"), zone[name])[1])
    got = warp.warp(value("fine").select("site", "row", "col", "v"), grids(spark, fine), grids(spark, target), ["site"], ["site"], ["v"]).collect()
    want = {(r.row, r.col): r.v for r in value("target").collect()}
    assert len(got) == 225 and all(r.v == pytest.approx(want[r.row, r.col], abs=1e-6) for r in got)


def test_grids_without_cells(spark):
    none = (1, 32, 0.0, 0.0, 1.0, 1.0, 0, 0)
    px = spark.createDataFrame([(1, 0, 0, 1.0)], "site int, row int, col int, v double")
    assert warp.warp(px, grids(spark, none), grids(spark, (1, 32, 0.0, 0.0, 1.0, 1.0, 2, 2)), ["site"], ["site"], ["v"]).collect() == []
    assert warp.warp(px.limit(0), grids(spark, (1, 32, 0.0, 9.0, 1.0, 1.0, 2, 2)), grids(spark, none), ["site"], ["site"], ["v"]).collect() == []


def brute_distance(cloudy):
    h, w = cloudy.shape
    at = np.argwhere(cloudy)
    if not len(at):
        return np.full((h, w), np.nan)
    r, c = np.mgrid[:h, :w]
    best = np.full((h, w), np.inf)
    for i, j in at:
        best = np.minimum(best, (r - i) ** 2 + (c - j) ** 2)
    return np.sqrt(best)


def test_distance_transform_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    scenes = {1: rng.random((300, 300)) < 0.002, 2: rng.random((9, 40)) < 0.1, 3: np.zeros((4, 4), bool), 4: np.ones((1, 3), bool)}
    rows = [(s, int(r), int(c), not bool(a[r, c])) for s, a in scenes.items() for r in range(a.shape[0]) for c in range(a.shape[1])]
    got = raster.cloud_distance(spark.createDataFrame(rows, "scene int, row int, col int, clear boolean"), ["scene"], "clear").toPandas()
    assert len(got) == len(rows)
    for s, a in scenes.items():
        mine = got[got.scene == s]
        d = np.full(a.shape, np.nan)
        d[mine.row, mine.col] = mine.distance
        assert np.allclose(d, brute_distance(a), equal_nan=True)


def test_fine_stack(spark):
    day = dt.date(2024, 1, 1)
    flat = lambda f: [5000.0 if not (f == "f1" and p == 0) else 0.0 for _ in range(4) for p in range(16)]
    tiles = spark.createDataFrame([(1, day, f, flat(f)) for f in ("f1", "f2", "f0")] + [(1, dt.date(2024, 1, 2), "f2b", flat("x"))], "site int, date date, filename string, bands array<double>")
    fine, coarse = (1, 32, 0.0, 40.0, 10.0, 10.0, 4, 4), (1, 32, 0.0, 40.0, 20.0, 20.0, 2, 3)
    got = products.prepare_fine(tiles, spark.createDataFrame([("f0",)], "filename string"), grids(spark, fine), grids(spark, coarse), 2).collect()
    assert {(r.date.day, r.filename) for r in got} == {(1, "f1"), (2, "f2b")} and len(got) == 32  # the third coarse column lies beyond the scene
    first = {(r.row // 2, r.col // 2): (r.distance, r.b02) for r in got if r.date == day and (r.row, r.col) != (0, 0)}
    assert first[0, 0][0] == 0.0 and first[1, 0][0] == first[0, 1][0] == 2.0 and first[0, 1][1] == 0.5  # scaled: no distance is above 1
    assert {(r.row // 2, r.col // 2): r.distance for r in got if r.date != day} == {(0, 0): 2.0, (0, 1): 1.0, (1, 0): 2.0, (1, 1): 1.0}
    assert math.isclose(next(r.b04 for r in got if r.date == day and (r.row, r.col) == (0, 0)), 0.0)
