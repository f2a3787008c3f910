"""Hand-computed cases of the end-to-end products and of the smaller operators."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.functions import dates, indices
from verdance.operators import gap, products, raster, series, smoothing

D = dt.date


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_periods_and_names(spark):
    year = F.lit(2024)
    assert one(spark, *dates.period(F.lit("2024-03-01/2024-04-02"), year)) == (D(2024, 3, 1), D(2024, 4, 2))
    assert one(spark, *dates.period(F.lit(None).cast("string"), year)) == (D(2024, 1, 1), D(2024, 12, 31)) == one(spark, *dates.period(F.lit("x/2024-01-01"), year))
    assert one(spark, dates.season_of_path(F.lit("a/12345/2019/2020/x"), F.lit(7)), dates.season_of_path(F.lit("a/b"), F.lit(7))) == (2019, 7)
    names = ["S2A_MSIL2A_20240101_REFL.tif", "REFL_20240105.tif", "composite_20240102.tif", "x.geotiff"]
    assert one(spark, *[dates.index_name(F.lit(n)) for n in names]) == ("20240101_ndvi.geotiff", "20240105_ndvi.geotiff", "composite_20240102.geotiff", "x.geotiff")
    assert one(spark, dates.withheld_day(F.lit(None).cast("date"), F.lit(names[0]))) == ("2024-01-01",)


def test_bands_and_text(spark):
    four, two = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.1, 0.5)]), F.array(F.lit(0.4), F.lit(None).cast("double"))
    assert one(spark, indices.gcc_of_bands(four), indices.gcc_of_bands(two), indices.enough_bands(four), indices.enough_bands(two)) == (pytest.approx(0.5), 0.4, True, False)
    assert one(spark, indices.escaped(F.lit("<a & 'b'>\""))) == ("&lt;a &amp; &#39;b&#39;&gt;&quot;",)


def test_positions(spark):
    lon, lat = one(spark, *raster.to_lonlat(*raster.to_utm(F.lit(7.25), F.lit(51.5))))
    assert (lon, lat) == (pytest.approx(7.25, abs=1e-8), pytest.approx(51.5, abs=1e-8))
    assert one(spark, *[raster.in_grid(F.lit(r), F.lit(c), 4, 3) for r, c in ((0, 0), (3, 2), (4, 0), (0, -1))]) == (True, True, False, False)
    px = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 1, 5.0), (2, 1, 1, float("nan"))], "scene int, row int, col int, v double")
    assert sorted(map(tuple, raster.pixel_sample(px, ["scene"], F.lit(1), F.lit(1), ["v"]).collect())) == [(1, 5.0), (2, None)]


def test_resampling_keeps_constants_and_means(spark):
    px = spark.createDataFrame([(1, r, c, 3.0, float(c)) for r in range(6) for c in range(6)], "scene int, row int, col int, k double, v double")
    for target, kernel in (((2, 3), "bilinear"), ((2, 2), "cubic"), ((9, 4), "bilinear"), ((6, 6), "cubic")):
        got = raster.resample_to(px, ["scene"], (6, 6), target, ["k", "v"], kernel).collect()
        assert len(got) == target[0] * target[1] and all(r.k == pytest.approx(3.0) for r in got)
        assert np.mean([r.v for r in got]) == pytest.approx(2.5)
    same = {(r.row, r.col): r.v for r in raster.resample_to(px, ["scene"], (6, 6), (6, 6), ["v"]).collect()}
    assert all(v == pytest.approx(c) for (_, c), v in same.items())


def test_nearest_by_one_sort(spark):
    acq = spark.createDataFrame([("a", D(2024, 1, 9), "x"), ("a", D(2024, 1, 11), "y"), ("a", D(2024, 1, 9), "w"), ("b", D(2024, 3, 1), "z")], "site string, date date, filename string")
    targets = spark.createDataFrame([("a", 1, D(2024, 1, 10)), ("a", 2, D(2024, 1, 11)), ("a", 3, D(2024, 2, 20)), ("b", 4, D(2024, 2, 25)), ("c", 5, D(2024, 1, 1))], "site string, id int, target date")
    got = {r.id: (r.nearest_day, r.nearest_name, r.distance) for r in series.nearest(targets, acq, ["site"], ["site", "id"], "target", 30).collect()}
    assert got == {1: (D(2024, 1, 9), "w", 1), 2: (D(2024, 1, 11), "y", 0), 4: (D(2024, 3, 1), "z", 5)}


def test_baseline_without_the_withheld_day(spark):
    rows = [("s", D(2024, 1, 1) + dt.timedelta(k), float(k % 3), k) for k in range(0, 12, 2)]
    entries = [("s", 15, rows[2][1], rows[2][1]), ("s", 30, None, D(2024, 1, 4)), ("t", 15, D(2024, 1, 1), D(2024, 1, 1))]
    got = {(r.site, r.gap_days): r.whittaker for r in gap.baseline_without(spark.createDataFrame(rows, "site string, date date, value double, pos long"), spark.createDataFrame(entries, "site string, gap_days int, withheld_date date, prediction_date date"), ["site"]).collect()}
    w, y = np.zeros(11), np.zeros(11)
    for _, day, v, _ in rows:
        if day != rows[2][1]:
            w[(day - D(2024, 1, 1)).days], y[(day - D(2024, 1, 1)).days] = 1, v
    d = np.diff(np.eye(11), 2, axis=0)
    assert got[("s", 15)] == pytest.approx(np.linalg.solve(np.diag(w) + smoothing.LAMBDA * d.T @ d, w * y)[4])
    assert got[("s", 30)] is None and got[("t", 15)] is None


def test_baselines_and_document(spark):
    rows = [("a", D(2024, 1, 1 + k), 0.3 + 0.01 * k, k, k % 2 == 0, k == 4, False) for k in range(10)]
    flagged = spark.createDataFrame(rows, "site string, date date, value double, pos long, fine boolean, excluded_aggressive boolean, excluded_nonaggressive boolean")
    found = products.baselines(flagged, F.col("fine"), ["site"])
    n = {r.baseline: r["count"] for r in found.groupBy("baseline").count().collect()}
    assert n == {"s2": 5, "s2_cloudfree_aggressive": 4, "s2_cloudfree_nonaggressive": 5, "s3_aggressive": 5, "s3_nonaggressive": 5, "s2_whittaker_aggressive": 9, "s2_whittaker_nonaggressive": 9}
    truth = flagged.select("date", (F.col("value") + 0.1).alias("value"), "pos")
    scored = products.scored(found, truth, ["site"], "baseline")
    grid = spark.createDataFrame([("a", f"aggressive_sigma{s}", "aggressive", s, "bti", 0.5 + s / 100) for s in (20, 30)], "site string, scenario string, strategy string, sigma int, mode string, nse double")
    stats = spark.createDataFrame([("a", 0.4)], "site string, mean double")
    out = json.loads(products.metrics_document(scored, grid, stats, ["site"]).first().document)
    assert out["derived"]["aggressive_bti"]["delta_nse"] == pytest.approx(-0.1) and out["ground_truth_stats"]["mean"] == 0.4
    assert out["baseline"]["s2"]["residual_mean"] == pytest.approx(-0.1) and out["temporal"]["aggressive_sigma20"]["nse"] == pytest.approx(0.7)


def test_cropped(spark):
    value = lambda some: spark.createDataFrame([("a", D(2024, 1, 1), r, c, v) for r, c, v in some], "site string, date date, row int, col int, value double")
    out = products.cropped(value([(0, 0, None), (1, 1, 0.3), (1, 2, None), (2, 2, 0.4)]), value([(1, 1, 7.0)]), value([(0, 0, 8.0), (1, 1, 9.0)]), 2, F.col("value") > 0.001)
    assert sorted((r.row, r.col, r.fused, r.fine, r.coarse) for r in out.collect()) == [(0, 0, 0.3, 7.0, 8.0), (0, 1, None, None, None), (1, 1, 0.4, None, 9.0)]
