"""Reading stages, files written and read again, and small cases of fusion by all scenarios and of gap experiments."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from verdance.operators import products, raster, reports
from verdance.sinks import writers
from verdance.sources import readers

D = dt.date
PX = "site string, row int, col int, date date"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_listing_stops_at_the_first_later_day(spark):
    listed = [(k, D(2024, 1, 1) + dt.timedelta(d)) for k, d in enumerate([0, 1, 3, 5, 4, 2, 6])]
    items = spark.createDataFrame([("a", *x) for x in listed] + [("b", 0, D(2024, 1, 2)), ("b", 1, None)], "site string, position int, date date")
    first, last = F.lit("2024-01-02").cast("date"), F.lit("2024-01-05").cast("date")
    assert rows_of(readers.listing_window(items, ["site"], "position", "date", first, last).select("site", "position")) == [("a", 1), ("a", 2), ("b", 0)]
    assert rows_of(readers.scan_bounds(items, ["site"], "position", "date", first, last, 1)) == [("a", 0, 3), ("b", 0, None)]
    assert readers.listing_window(items.limit(0), ["site"], "position", "date", first, last).count() == 0


def test_regions_scenes_and_cubes(spark):
    regions = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, ""), ("b", 2, "z"), ("c", 1, None)], "site string, position int, summary string")
    assert rows_of(readers.first_region(regions)) == [("a", "x")]
    bands = spark.createDataFrame([(s, b) for s, bs in ((1, "abcd"), (2, "abc"), (3, "aabbccdd"), (4, "abcx")) for b in bs], "scene int, band string")
    assert {r[0] for r in readers.whole_scenes(bands, ["scene"], "band", list("abcd")).collect()} == {1, 3}
    noon = dt.datetime(2024, 5, 1, 12)
    cube = spark.createDataFrame([("s", [noon, noon + dt.timedelta(hours=1), noon + dt.timedelta(1)], [[1.0], [2.0], None], [[9.0]] * 3)], "site string, t array<timestamp>, B02 array<array<double>>, B99 array<array<double>>")
    got = readers.time_steps(readers.renamed(cube, {"B02": "b02"}), ["site"], "t", ["b02"])
    assert rows_of(got.select("step", "increment", "filename", "b02")) == [(0, 0, "20240501_0.geotiff", [1.0]), (1, 1, "20240501_1.geotiff", [2.0]), (2, 0, "20240502_0.geotiff", None)]


def test_site_seasons_of_files(spark, tmp_path):
    for path in ("a/2024/raw/t/s.json", "a/2023/raw/t/s.json", "b/x/raw/t/s.json", "c/2024/raw/s.json"):
        (tmp_path / path).parent.mkdir(parents=True)
        (tmp_path / path).write_text("[]")
    assert rows_of(readers.site_seasons_below(spark, str(tmp_path), "raw/t/s.json")) == [("a", 2023), ("a", 2024)]


def test_cached_table_is_made_once(spark, tmp_path):
    made = []

    def make(n=2):
        made.append(n)
        return spark.range(n)

    where = str(tmp_path / "cache")
    assert readers.cached_or(spark, where, lambda: make(0)).count() == 0  # an empty table is asked for again
    assert readers.cached_or(spark, where, make).count() == 2 == readers.cached_or(spark, where, make).count()
    assert made == [0, 2]


def test_manifest_round_trip(spark, tmp_path):
    d = D(2024, 6, 1)
    entries = [("a", 2024, g, "green_up", d, d, d, d, *held) for g, held in ((30, (None, None)), (15, (d, "x_20240601.tif")))]
    table = spark.createDataFrame(entries, "site string, season int, gap_days int, midpoint_rule string, midpoint_date date, window_start date, window_end date, prediction_date date, withheld_date date, withheld_filename string")
    writers.manifest(table, str(tmp_path / "m"))
    got = readers.manifest(spark, str(tmp_path / "m"))
    assert rows_of(got) == rows_of(table) and [r.gap_days for r in got.collect()] == [15, 30]
    with pytest.raises(FileNotFoundError):
        readers.manifest(spark, str(tmp_path / "none"))


def test_series_and_tiles_round_trip(spark, tmp_path):
    days = [("a", D(2024, 1, k), k, f'f"{k}') for k in (3, 1, 2)] + [("b", D(2024, 1, 1), None, None)]
    table = spark.createDataFrame(days, "site string, date date, n int, filename string")
    writers.records_json(writers.ordered(table, ["site"], ["date"]), str(tmp_path / "j"), ("site",))
    back = spark.read.schema("date date, n int, filename string, site string").json(str(tmp_path / "j"))
    assert rows_of(back.select(table.columns)) == rows_of(table)
    assert [r.n for r in spark.read.json(str(tmp_path / "j" / "site=a")).collect()] == [1, 2, 3]
    writers.records_csv(table, str(tmp_path / "c"), ("date", "filename", "n"), ("site",))
    assert rows_of(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).select("site", "filename")) == rows_of(table.select("site", "filename"))
    tiles = spark.createDataFrame([("a", 2024, [1.0, None], {"angle": "3.5"})], "site string, season int, b02 array<double>, tags map<string,string>")
    writers.tiles(tiles, str(tmp_path / "t"))
    assert rows_of(spark.read.parquet(str(tmp_path / "t")).select(tiles.columns)) == rows_of(tiles)


def test_window_and_paths(spark):
    corner = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((2, 9), (6, 8), (7, 13), (3, 12))]
    found = raster.envelope_window(corner, *[F.lit(v) for v in (0.0, 0.0, 6.5, 12.5, 0.5, 0.25)])
    assert tuple(spark.range(1).select(*found).first()) == (0.0, 4.0, 18.0, 9.0)
    path = lambda mode, sigma: spark.range(1).select(writers.product_path(F.lit("fusion"), F.lit("aggressive"), F.lit(mode), F.lit(sigma))).first()[0]
    assert path("bti", 20) == "prepared_aggressive/fusion" and path("itb", 30) == "prepared_aggressive_itb/fusion_sigma30"


def test_plot_marks_the_nearest_day(spark):
    rows = [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 3), 3.0), ("a", D(2024, 1, 5), None), ("b", D(2024, 1, 9), 2.0)]
    got = reports.plotted(spark.createDataFrame(rows, "s string, date date, v double"), ["s"], "v", F.lit("2024-01-02").cast("date"), 100.0, 80.0)
    assert {(r.s, r.v): (r.x, r.y, r.marked) for r in got.collect()} == {("a", 1.0): (30.0, 50.0, True), ("a", 3.0): (70.0, 30.0, False), ("b", 2.0): (30.0, 50.0, True)}


def test_all_scenarios_of_one_pixel(spark):
    days = [D(2024, 1, 1), D(2024, 1, 3)]
    fine = spark.createDataFrame([("s", 0, 0, days[0], 0.1, 0.2, 0.1, 0.4, None, False, True)], PX + ", b02 double, b03 double, b04 double, b8a double, distance double, excluded_aggressive boolean, excluded_nonaggressive boolean")
    coarse = spark.createDataFrame([("s", 0, 0, d, 0.2, 0.2, 0.2, 0.3) for d in days], PX + ", b02 double, b03 double, b04 double, b8a double")
    got = {(r.scenario, r.date): r for r in products.fused_scenarios(fine, coarse).collect()}
    assert set(got) == {(f"aggressive_sigma{s}{m}", d) for s in (20, 30) for m in ("", "_itb") for d in days}
    one = got[("aggressive_sigma20", days[1])]
    assert (one.b02, one.b8a, one.greenness_index) == pytest.approx((0.1, 0.4, 0.5)) and got[("aggressive_sigma30_itb", days[1])].b02 is None
    series = {(r.scenario, r.date): r for r in products.scenario_series(products.fused_scenarios(fine, coarse), F.lit(0), F.lit(0)).collect()}
    assert series[("aggressive_sigma20", days[1])].ndvi == pytest.approx(0.6) and series[("aggressive_sigma20_itb", days[1])].greenness_index == pytest.approx(0.5)


def test_gap_experiment_scores_against_the_withheld_day(spark):
    held, other = D(2024, 5, 10), D(2024, 5, 1)
    value = lambda c, d: 0.3 + 0.1 * c + (0.05 if d == held else 0.0)
    fine = spark.createDataFrame([("s", 0, c, d, value(c, d), None) for c in range(3) for d in (held, other)], PX + ", value double, distance double")
    coarse = spark.createDataFrame([("s", 0, c, d, 0.5) for c in range(3) for d in (held, other)], PX + ", value double")
    entries = spark.createDataFrame([("s", 2024, 15, held, held, held, held), ("s", 2024, 30, held, None, held, held), ("t", 2024, 15, held, held, held, held)], "site string, season int, gap_days int, prediction_date date, withheld_date date, window_start date, window_end date")
    got = {(r.site, r.gap_days): r for r in products.gap_experiment(entries, fine, coarse).collect()}
    assert got[("s", 15)].n_pixels == 3 and got[("s", 15)].error is None
    assert (got[("s", 15)].rmse, got[("s", 15)].mean_bias) == pytest.approx((0.05, -0.05)) and got[("s", 15)].rmse_nogap < 0.05
    assert got[("s", 30)].error == "no acquisition to withhold" and got[("t", 15)].error == "no common pixels"
