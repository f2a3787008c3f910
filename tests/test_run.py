"""The graph of a run on a small site, and the documents of a validation run."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from verdance.operators import phenology, products, raster, series
from verdance.operators.run import Run
from verdance.sinks import writers

D = dt.date
CELL = "site string, row int, col int, date date"
BANDS = ", ".join(f"{b} double" for b in raster.BANDS)


@pytest.fixture(scope="module")
def run(spark):
    days = [D(2024, 5, 1) + dt.timedelta(k) for k in range(12)]
    value = lambda k, c: (0.1, 0.2 + 0.01 * k, 0.1, 0.4 + 0.01 * c)
    coarse = [("a", r, c, d, *value(k, c)) for k, d in enumerate(days) for r in range(3) for c in range(4)]
    # the last column is never valid: its fine and coarse values are zero
    coarse = [(*x[:4], *([0.0] * 4 if x[2] == 3 else x[4:])) for x in coarse]
    fine = [(*x, 99.0, x[3].day % 4 == 0, False) for x in coarse if x[3].day % 2 == 0]
    truth = [("a", d, 0.4 + 0.01 * k, k) for k, d in enumerate(days)]
    frames = spark.createDataFrame(fine, f"{CELL}, {BANDS}, distance double, excluded_aggressive boolean, excluded_nonaggressive boolean"), spark.createDataFrame(coarse, f"{CELL}, {BANDS}")
    return Run(*frames, spark.createDataFrame(truth, "site string, date date, value double, pos long"), F.lit(1), F.lit(2))


def test_products_follow_from_each_other(run):
    assert {r[0] for r in run.fused.select("col").distinct().collect()} == {0, 1, 2, 3}
    assert {r[0] for r in run.cropped.select("col").distinct().collect()} == {0, 1, 2}  # cut to the valid extent
    scenarios = {f"{s}_sigma{w}{m}" for s in ("aggressive", "nonaggressive") for w in (20, 30) for m in ("", "_itb")}
    got = run.metrics.collect()
    names = {(r.section, r.name) for r in got}
    assert {n for s, n in names if s == "temporal"} == scenarios
    assert {n for s, n in names if s == "baseline"} == {"s2", "s3_aggressive", "s3_nonaggressive", *[f"s2_{k}_{s}" for k in ("cloudfree", "whittaker") for s in ("aggressive", "nonaggressive")]}
    n = {r.name: r.n_samples for r in got}
    assert n["s2"] == 6 and n["s2_cloudfree_aggressive"] == 3 and n["s2_whittaker_aggressive"] == 9 and n["s3_aggressive"] == 12 == n["aggressive_sigma20"]


def test_fused_equal_stacks_are_the_stack(run):
    """Fine is coarse where both are known, so residuals are zero and the fused greenness is the coarse one."""
    got = {(r.scenario, r.date): r for r in run.series.collect()}
    one = got[("nonaggressive_sigma30", D(2024, 5, 4))]
    assert one.greenness_index == pytest.approx(0.23 / 0.43) and one.b03 == pytest.approx(0.23)
    assert got[("nonaggressive_sigma30_itb", D(2024, 5, 4))].greenness_index == pytest.approx(0.23 / 0.43)


def test_document_is_a_projection(run):
    out = json.loads(run.document.first().document)
    flat = {(r.section, r.name): r for r in run.metrics.collect()}
    assert out["temporal"].keys() == {n for s, n in flat if s == "temporal"} and out["baseline"]["s2"]["n_samples"] == 6
    assert out["temporal"]["aggressive_sigma20"]["rmse"] == pytest.approx(flat["temporal", "aggressive_sigma20"].rmse) and set(out["derived"]) == {f"{s}_{m}" for s in ("aggressive", "nonaggressive") for m in ("bti", "itb")}


def test_summary_keeps_errors(spark):
    results = spark.createDataFrame([("a", 2024, 30, None, "no common pixels"), ("a", 2024, 15, 4, None)], "site string, season int, gap_days int, n_pixels int, error string")
    crossover = spark.createDataFrame([("a", 2024, None)], "site string, season int, crossover_days int")
    doc = json.loads(writers.run_summary(results, crossover, "aggressive_sigma20", ["run", "--all"], "abc").first().document)
    assert [e["gap_days"] for e in doc["results"]] == [15, 30] and doc["results"][1]["error"] == "no common pixels" and doc["results"][1]["n_pixels"] is None
    assert doc["crossover_days"] is None and doc["command_line"] == ["run", "--all"] and doc["revision"] == "abc"


def test_numbered_listing(spark):
    rows = spark.createDataFrame([(k % 3, f"x{k:03}") for k in range(200)], "day int, name string").repartition(5)
    got = series.numbered(rows, ["day", "name"]).collect()
    assert [(r.day, r.name) for r in sorted(got, key=lambda r: r.position)] == sorted((k % 3, f"x{k:03}") for k in range(200)) and {r.position for r in got} == set(range(200))
    assert series.numbered(rows.limit(0), ["day"]).collect() == []


def test_seasons_of_three_years(spark):
    """Triangles of known crossings, a spike, a leap year, and a lone year that stands for three."""

    def year(y, peak):
        first = D(y, 1, 1)
        return [(first + dt.timedelta(k), 0.2 + 0.4 * max(0.0, 1 - abs(k - peak) / 100)) for k in range(0, 366 if y % 4 == 0 else 365, 3)]

    rows = [("a", *x) for y, p in ((2019, 170), (2020, 180), (2021, 200)) for x in year(y, p)] + [("b", *x) for x in year(2020, 180)]
    rows = [(s, d, 5.0 if (s, d) == ("a", D(2020, 2, 9)) else v) for s, d, v in rows] + [("a", D(2020, 7, 2), float("nan")), ("a", D(2020, 7, 3), -1.0)]
    got = {(r.site, r.season): r for r in phenology.season_of_three_years(spark.createDataFrame(rows, "site string, date date, value double"), ["site"]).collect()}
    assert set(got) == {("a", 2019), ("a", 2020), ("a", 2021), ("b", 2020)}
    one, alone = got["a", 2020], got["b", 2020]
    assert one.stack == "three_independent_years" and alone.stack == "single_year_replicated" == got["a", 2019].stack
    for r in (one, alone):  # half of the way is 50 days from the peak
        assert abs((r.green_up - D(2020, 1, 1)).days - 130) <= 1 and abs((r.green_down - D(2020, 1, 1)).days - 230) <= 1 and r.peak == pytest.approx(0.6, abs=0.02) and r.fitted_max < 0.7
    assert abs((got["a", 2021].green_up - D(2021, 1, 1)).days - 150) <= 1
    wanted = spark.createDataFrame([("a", 2020), ("c", 2020)], "site string, season int")
    assert {(r.site, r.green_up is None) for r in products.phenology_of_three_years(wanted, spark.createDataFrame(rows, "site string, date date, value double")).collect()} == {("a", False), ("c", True)}
