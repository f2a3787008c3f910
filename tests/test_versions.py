"""Products that grow: what is appended equals what is made at once, and only new scenes are touched."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from verdance.operators import products, raster, series
from verdance.sinks.versions import Conflict, Store

D = dt.date
BANDS = ", ".join(f"{b} double" for b in raster.BANDS)


def rows_of(frame, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.select(*columns).collect())


def test_versions_and_conflicts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["site", "date"])
    row = lambda *r: spark.createDataFrame(list(r), "site string, date int, v int")
    assert store.version == 0 and store.parts() == [] and store.unseen(row(("a", 1, 0))).count() == 1
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.commit(row(("a", 1, 1), ("a", 1, 2), ("b", 1, 3))) == 1
    assert store.commit(row(("a", 1, 9), ("c", 1, 4)), row(("d", 1, 0))) == 2
    assert rows_of(store.read(), "site", "v") == [("a", 9), ("b", 3), ("c", 4)] and rows_of(store.read(1), "site", "v") == [("a", 1), ("a", 2), ("b", 3)]
    assert rows_of(store.unseen(row(("a", 1, 0), ("a", 2, 0), ("d", 1, 0))), "site", "date") == [("a", 2)]
    with pytest.raises(Conflict):
        store.commit(row(("x", 1, 1)), after=1)
    assert store.version == 2 and store.commit(row(("a", 1, 0)).limit(0)) == 3 and rows_of(store.read(), "site", "v") == rows_of(store.read(2), "site", "v")


def test_coarse_stack_grows(spark, tmp_path):
    rng = random.Random(4)
    scenes = [(site, D(2024, 1, 1) + dt.timedelta(3 * k), f"{site}{k}{x}") for site in "ab" for k in range(12) for x in "xy" if x == "x" or k % 4 == 0]
    px = [(*s, r, c, *[rng.random() + 0.1 for _ in raster.BANDS]) for s in scenes for r in range(4) for c in range(4)]
    pixels = spark.createDataFrame(px, f"site string, date date, filename string, row int, col int, {BANDS}").cache()
    excluded = spark.createDataFrame([("a3x",)], "filename string")
    whole = products.prepare_coarse(pixels, excluded, (4, 4), (2, 2))
    composites, smoothed = (Store(spark, str(tmp_path / n), ["site", "date"]) for n in ("c", "s"))
    first = pixels.filter("not (filename in ('a5x', 'a8y', 'b11x'))")
    assert products.grow_coarse(composites, smoothed, first, excluded, (4, 4), (2, 2)) == (21, 21)
    assert products.grow_coarse(composites, smoothed, first, excluded, (4, 4), (2, 2)) == (0, 0)
    # a5x is a new day, a8y joins one, b11x is the last: two composites to either side of each are averaged again
    assert products.grow_coarse(composites, smoothed, pixels, excluded, (4, 4), (2, 2)) == (3, 8 + 3)
    columns = ["site", "date", "row", "col", *raster.BANDS]
    assert rows_of(smoothed.read(), *columns) == rows_of(whole, *columns) and smoothed.version == 2


def test_fine_stack_grows(spark, tmp_path):
    grid = "site string, zone int, x0 double, y0 double, dx double, dy double, height int, width int"
    fine, coarse = (spark.createDataFrame([("a", 32, 0.0, 40.0, d, d, n, n)], grid) for d, n in ((10.0, 4), (20.0, 2)))
    rng = random.Random(2)
    tile = lambda day, name: ("a", D(2024, 1, day), name, [rng.random() * 9000 for _ in range(64)])
    tiles = spark.createDataFrame([tile(1, "k"), tile(1, "j"), tile(2, "m"), tile(3, "n")], "site string, date date, filename string, bands array<double>").cache()
    store = Store(spark, str(tmp_path / "f"), ["site", "date", "filename"])
    assert products.grow_fine(store, tiles.filter("filename in ('k', 'm')"), None, fine, coarse, 2) == 2
    assert products.grow_fine(store, tiles, None, fine, coarse, 2) == 2 and products.grow_fine(store, tiles, None, fine, coarse, 2) == 0
    chosen = products.day_scenes(tiles, None)
    columns = ["site", "date", "filename", "row", "col", *raster.BANDS, "distance"]
    whole = products.prepare_fine(tiles, None, fine, coarse, 2)
    assert rows_of(store.read().fillna(-1.0).join(chosen, ["site", "date", "filename"], "left_semi"), *columns) == rows_of(whole.fillna(-1.0), *columns)


def test_nearest_product_stays_in_its_season(spark):
    have = spark.createDataFrame([("s", "fused", D(2023, 12, 31), "a"), ("s", "fused", D(2024, 1, 9), "b"), ("s", "fused", D(2024, 1, 11), "c"), ("s", "fine", D(2024, 12, 30), "d"), ("s", "fine", D(2025, 1, 1), "e")], "site string, kind string, date date, filename string")
    targets = spark.createDataFrame([("s", 2024, D(2024, 1, 1)), ("s", 2024, D(2024, 1, 10)), ("s", 2024, D(2024, 12, 31)), ("s", 2022, D(2022, 5, 5))], "site string, season int, target date")
    got = {(r.target, r.kind): (r.nearest_name, r.distance) for r in series.nearest_in_season(targets, have, ["site"], ["fused", "fine"]).collect()}
    assert got == {(D(2024, 1, 1), "fused"): ("b", 8), (D(2024, 1, 10), "fused"): ("b", 1), (D(2024, 12, 31), "fused"): ("c", 355), (D(2024, 1, 1), "fine"): ("d", 364), (D(2024, 1, 10), "fine"): ("d", 355), (D(2024, 12, 31), "fine"): ("d", 1)}
