"""Hand-computed cases, properties and independent restatements of the operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdance.operators import fusion, gap, metrics, phenology, raster, reports, screening, series, smoothing
from verdance.sinks import writers

D = dt.date


def day(k: int) -> dt.date:
    return D(2024, 1, 1) + dt.timedelta(days=k)


def test_exclusion_needs_both_tests(spark):
    rows = [("a", "S2", d, v, 1000.0) for d, v in ((0, 0.9), (10, 0.1), (14, None), (20, 0.5), (24, 0.2))]
    got = screening.flag_exclusions(spark.createDataFrame(rows, "site string, source string, day int, ndvi double, b02 double"), 100.0).orderBy("day").collect()
    assert [r.neighbours for r in got] == [2, 4, 4, 3, 3]
    assert [r.window_max for r in got] == [0.9, 0.9, 0.9, 0.5, 0.5]
    assert [r.excluded_aggressive for r in got] == [False, True, True, False, True]
    assert [r.excluded_nonaggressive for r in got] == [False, True, True, False, False]


def test_dark_limit_is_strict(spark):
    rows = spark.createDataFrame([(0.009,), (0.01,), (None,)], "b02 double")
    assert [r[0] for r in rows.select(screening.dark(F.col("b02"), screening.dark_limit(F.lit("S3")))).collect()] == [True, False, False]


def test_duplicate_day_policies(spark):
    rows = spark.createDataFrame([(day(0), None, 0), (day(0), 5.0, 1), (day(1), 1.0, 2), (day(1), 2.0, 3)], "date date, value double, pos int")
    pick = lambda p: {r.date: r.value for r in series.dedupe(rows, ["date"], "value", "pos", p).collect()}
    assert pick("first") == {day(0): None, day(1): 1.0}
    assert pick("last") == {day(0): 5.0, day(1): 2.0}
    assert pick("first_valid") == {day(0): 5.0, day(1): 1.0}


def test_null_first_value_drops_the_day(spark):
    a = spark.createDataFrame([("x", day(0), None, 0), ("x", day(0), 5.0, 1), ("x", day(1), 3.0, 2)], "scenario string, date date, value double, pos int")
    b = spark.createDataFrame([(day(0), 1.0, 0), (day(1), 2.0, 1)], "date date, value double, pos int")
    assert [(r.date, r.pred, r.truth) for r in series.match_days(a, b, ["scenario"], []).collect()] == [(day(1), 3.0, 2.0)]


@pytest.mark.parametrize(("pred", "nse", "r"), [((1, 2, 3), 1.0, 1.0), ((2, 2, 2), 0.0, None), ((3, 2, 1), -3.0, -1.0)])
def test_efficiency_and_correlation(spark, pred, nse, r):
    rows = spark.createDataFrame([("s", day(k), float(p), float(k + 1)) for k, p in enumerate(pred)], "scenario string, date date, pred double, truth double")
    got = metrics.temporal_metrics(rows, ["scenario"]).collect()[0]
    assert got.nse == pytest.approx(nse) and got.r_squared == got.nse
    assert got.pearson_r == (None if r is None else pytest.approx(r))


def test_residual_spread_is_of_the_population(spark):
    rows = spark.createDataFrame([("s", day(0), 1.0, 1.0), ("s", day(1), 3.0, 1.0)], "scenario string, date date, pred double, truth double")
    got = metrics.temporal_metrics(rows, ["scenario"]).collect()[0]
    assert (got.residual_std, got.nse, got.n_samples) == (1.0, None, 2)
    assert metrics.temporal_metrics(rows.limit(1), ["scenario"]).count() == 0


def test_moving_average_counts_composites(spark):
    rows = spark.createDataFrame([("p", k * 9, v) for k, v in enumerate((1.0, 0.0, 3.0, 5.0, 7.0))], "p string, t int, v double")
    assert [r.smoothed for r in smoothing.moving_average(rows, ["p"], "t", "v").orderBy("t").collect()] == [2, 3, 4, 5, 5]
    assert [r.smoothed for r in smoothing.moving_average(rows, ["p"], "t", "v", 1).orderBy("t").collect()] == [1, 0, 3, 5, 7]


def test_composite_masks_only_where_several(spark):
    rows = spark.createDataFrame([(day(0), 0, 0, 1, *[6.0] * 4), (day(0), 0, 0, 2, *[2.0] * 4), (day(1), 0, 0, 3, *[6.0] * 4)], "date date, row int, col int, acquisition int, b02 double, b03 double, b04 double, b8a double")
    got = {r.date: r.b02 for r in raster.composite(rows, ["date"]).collect()}
    assert got == {day(0): 2.0, day(1): 6.0}


def test_interpolation_and_grid(spark):
    rows = spark.createDataFrame([("k", day(1), 1.0), ("k", day(3), 3.0)], "k string, date date, value double")
    grid = series.day_grid(rows, ["k"], start=F.lit("2024-01-01").cast("date"), end=F.lit("2024-01-05").cast("date")).join(rows, ["k", "date"], "left")
    assert [r.filled for r in series.interpolate(grid, ["k"]).orderBy("date").collect()] == [1, 1, 2, 3, 3]


def test_nearest_takes_the_earlier_of_equals(spark):
    targets = spark.createDataFrame([(1, day(10))], "site int, target date")
    acquisitions = spark.createDataFrame([(1, day(9), "b"), (1, day(11), "a"), (1, day(9), "c")], "site int, date date, filename string")
    got = series.nearest(targets, acquisitions, ["site"], ["site"], "target", 30).collect()
    assert [(r.nearest_day, r.nearest_name) for r in got] == [(day(9), "b")]
    assert series.nearest(targets, acquisitions.filter("filename = 'x'"), ["site"], ["site"], "target", 30).count() == 0


def test_distances(spark):
    rows = spark.createDataFrame([("s", 0, 0, False), ("s", 0, 1, True), ("s", 1, 1, True), ("t", 0, 0, True)], "scene string, row int, col int, clear boolean")
    got = {(r.scene, r.row, r.col): r.distance for r in raster.cloud_distance(rows, ["scene"], "clear").collect()}
    assert got == {("s", 0, 0): 0.0, ("s", 0, 1): 1.0, ("s", 1, 1): pytest.approx(2**0.5), ("t", 0, 0): None}
    d = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), ("b", 2.0)], "scene string, distance double")
    got = raster.rescale_distance(d, ["scene"]).orderBy("scene", "distance").collect()
    assert [r.distance for r in got] == [0, 2, 2, 0, 1, 2]


def test_crop_twice_is_crop(spark):
    rows = spark.createDataFrame([("s", r, c, 1.0 if 1 <= r <= 2 and c == 2 else None) for r in range(4) for c in range(4)], "scene string, row int, col int, b02 double")
    once = raster.crop(rows, ["scene"], raster.extent(rows, ["scene"], raster.valid(("b02",))))
    twice = raster.crop(once, ["scene"], raster.extent(once, ["scene"], raster.valid(("b02",))))
    assert sorted(map(tuple, once.select("row", "col").collect())) == [(0, 0), (1, 0)] == sorted(map(tuple, twice.select("row", "col").collect()))


@pytest.mark.parametrize("kernel", ["bilinear", "cubic"])
def test_resampling_keeps_a_constant(spark, kernel):
    rows = spark.createDataFrame([("s", r, c, 0.7 if (r, c) != (1, 1) else None) for r in range(3) for c in range(3)], "scene string, row int, col int, v double")
    got = raster.resample(rows, ["scene"], 3, 3, 4, "v", kernel).collect()
    assert len(got) >= 140 and all(abs(r.v - 0.7) < 1e-9 for r in got)


def test_whittaker_solves_its_equations(spark):
    rng = np.random.default_rng(3)
    n, seen = 40, sorted(rng.choice(40, 25, replace=False).tolist() + [0, 39])
    w, y = np.zeros(n), np.zeros(n)
    for k in seen:
        w[k], y[k] = 1.0, rng.random()
    d = np.diff(np.eye(n), 2, axis=0)
    want = np.linalg.solve(np.diag(w) + 400 * d.T @ d, w * y)
    assert smoothing.solve_whittaker(w, y, 400.0) == pytest.approx(want, abs=1e-9)
    rows = spark.createDataFrame([("k", day(int(k)), float(y[k]), int(k)) for k in set(seen)] + [("one", day(0), 1.0, 0)], "k string, date date, value double, pos int")
    got = smoothing.whittaker(rows, ["k"]).orderBy("date").collect()
    assert [r.date for r in got] == [day(k) for k in range(n)] and [r.smoothed for r in got] == pytest.approx(want, abs=1e-9)


def test_crossover_is_strict(spark):
    rows = spark.createDataFrame([("k", 15, 0.5, 0.4), ("k", 30, 0.3, 0.3), ("k", 60, 0.1, 0.2), ("n", 15, None, 0.1)], "k string, gap_days int, fusion double, baseline double")
    assert {r.k: r.crossover_days for r in smoothing.crossover(rows, ["k"]).collect()} == {"k": 60, "n": None}


def test_fusion_of_equal_stacks_is_the_stack(spark):
    low = [(1, 0, 0, day(k), 0.1 * k) for k in range(5)]
    high = [(*r, 100.0) for r in low if r[3] != day(2)]
    targets = spark.createDataFrame([(1, day(2), 20), (1, day(2), 30)], "site int, date date, sigma int")
    lows = spark.createDataFrame(low, "site int, row int, col int, date date, value double")
    highs = spark.createDataFrame(high, "site int, row int, col int, date date, value double, distance double")
    got = fusion.fuse(highs, lows, targets, ["site"]).collect()
    assert len(got) == 2 and all(r.fused == pytest.approx(0.2) and r.n_acquisitions == 4 for r in got)
    cloudy = fusion.fuse(highs.withColumn("distance", F.lit(1.0)), lows, targets, ["site"]).collect()
    assert [r.fused for r in cloudy] == [None, None]


def test_fusion_carries_the_residual(spark):
    lows = spark.createDataFrame([(1, 0, 0, day(k), 0.2) for k in range(40)], "site int, row int, col int, date date, value double")
    highs = spark.createDataFrame([(1, 0, 0, day(0), 0.5, None), (1, 0, 0, day(39), 0.9, None)], "site int, row int, col int, date date, value double, distance double")
    targets = spark.createDataFrame([(1, day(5), 20)], "site int, date date, sigma int")
    assert [r.fused for r in fusion.fuse(highs, lows, targets, ["site"]).collect()] == [pytest.approx(0.5)]  # the other is out of reach


def test_season_of_a_triangle(spark):
    rows = spark.createDataFrame([("k", d, float(min(d, 200 - d))) for d in range(0, 201)], "k string, day int, value double")
    got = phenology.season(rows, ["k"]).collect()[0]
    assert got.peak_day == 100 and got.start == pytest.approx(50, abs=1) and got.end == pytest.approx(150, abs=1)


def test_gap_manifest_and_masks(spark):
    sites = spark.createDataFrame([("a", 2024, D(2024, 5, 1), None), ("b", 2024, D(2023, 5, 1), None)], "site string, season int, green_up date, green_down date")
    acquisitions = spark.createDataFrame([("a", D(2024, 4, 30), "x"), ("a", D(2024, 5, 2), "y"), ("a", D(2024, 6, 30), "z")], "site string, date date, filename string")
    entries = gap.manifest(sites, acquisitions)
    got = {(r.site, r.gap_days): r for r in entries.collect()}
    assert len(got) == 8 and got["a", 15].withheld_filename == "x" and got["b", 15].midpoint_date == D(2024, 7, 1) and got["b", 15].withheld_date is None
    count = lambda mask: {r.gap_days: r["count"] for r in gap.masked(acquisitions, entries, mask).filter("site = 'a'").groupBy("gap_days").count().collect()}
    assert count("withheld_day") == {15: 2, 30: 2, 60: 2, 90: 2}
    assert count("window") == {15: 1, 30: 1, 60: 1, 90: 1}


def test_export_and_documents(spark, tmp_path):
    a = spark.createDataFrame([(day(0), "n", 0.1)], "date date, filename string, ndvi double")
    b = spark.createDataFrame([(day(0), "g", 0.2), (day(1), "h", 0.3)], "date date, filename string, greenness_index double")
    c = spark.createDataFrame([(day(0), "q", None, 1.0, 1.0, 1.0)], "date date, filename string, b02 double, b03 double, b04 double, b8a double")
    merged = series.export_merge(a, b, c)
    assert {r.date: r.filename for r in merged.collect()} == {day(0): "q", day(1): "h"}
    writers.records_csv(merged, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(writers.EXPORT)
    doc = writers.document(b.withColumn("k", F.lit(1)), ["k"], ["date"], ["date", "filename"], "doc").collect()[0].doc
    assert doc == '[{"date":"2024-01-01","filename":"g"},{"date":"2024-01-02","filename":"h"}]'
    nested = writers.nested(b.withColumn("k", F.lit(1)), ["k"], F.col("filename"), F.col("greenness_index"), "doc").collect()[0].doc
    assert nested == '{"g":0.2,"h":0.3}'


def test_report_order(spark):
    rows = spark.createDataFrame([("s2_whittaker_x",), ("s2",), ("s2_cloudfree_x",), ("s3_x",)], "baseline string")
    assert [r.baseline for r in reports.baseline_order(rows).orderBy("order_key").collect()] == ["s2", "s3_x", "s2_cloudfree_x", "s2_whittaker_x"]
