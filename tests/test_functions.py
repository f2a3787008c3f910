"""Hand-computed cases of the column functions."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from verdance.functions import dates, indices
from verdance.operators import raster
from verdance.sources import readers

D = dt.date


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_gcc_variants(spark):
    rows = [(0.1, 0.2, 0.1), (0.3, 0.2, 0.1), (0.0, 0.0, 0.0), (float("nan"), 0.2, 0.1), (-0.1, 0.2, 0.3)]
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    got = values(spark, rows, "b double, g double, r double", indices.gcc(b, g, r), indices.gcc_rgr(g, r), indices.gcc_raster(b, g, r), indices.gcc_strict(b, g, r))
    assert got[0] == pytest.approx((0.5, 0.5, 0.5, 0.5))
    assert got[1] == pytest.approx((1 / 3, 0.5, 1 / 3, 1 / 3))
    assert got[2] == (None, 0.0, 0.0, None)
    assert got[3][0] is None and got[3][2] == 0.0 and got[3][3] is None
    assert got[4][0] is None and got[4][3] == pytest.approx(0.5)


def test_nan_is_not_positive(spark):
    rows = [(float("nan"), 0.5), (0.2, 0.6), (0.0, 0.5), (None, 0.5)]
    got = values(spark, rows, "red double, nir double", indices.ndvi(F.col("red"), F.col("nir")))
    assert got == [(None,), (pytest.approx(0.5),), (None,), (None,)]


def test_text_values(spark):
    rows = [("0.4", "0.5", "0"), ("", "0.5", None), ("-9999", "0.5", "0"), ("0.4", "0.5", "1.0"), ("NA", None, ""), ("nan", None, None)]
    got = values(spark, rows, "a string, b string, f string", indices.truth_value(F.col("a"), F.col("b"), F.col("f")))
    assert got == [(0.4,), (0.5,), (None,), (None,), (None,), (None,)]
    got = values(spark, [("0.1", "0.2", "0.1"), ("x", "0.2", "0.1"), ("0", "0", "0")], "b string, g string, r string", indices.gcc_of_text(F.col("b"), F.col("g"), F.col("r")))
    assert got == [(pytest.approx(0.5),), (None,), (None,)]


def test_filename_dates(spark):
    names = ["S2A_MSIL2A_20240101_REFL.tif", "composite_20240105.tif", "x.tif", "a_20240199_b.tif", "s_20240101_dist_cloud.TIF"]
    got = values(spark, [(n,) for n in names], "n string", dates.filename_date(F.col("n")), dates.product_day(F.col("n")), dates.filename_day_or_stem(F.col("n")))
    assert [g[0] for g in got] == [D(2024, 1, 1), D(2024, 1, 5), None, None, D(2024, 1, 1)]
    assert got[0][1] == "20240101" and got[1][1] == "" and got[4][1] == "20240101"
    assert got[2][2] == "x.tif"


def test_year_days(spark):
    got = values(spark, [(2024366.0,), (2023001.2,), (99999.0,), (float("nan"),), (None,)], "x double", dates.from_year_day(F.col("x")))
    assert [g[0] for g in got] == [D(2024, 12, 31), D(2023, 1, 1), None, None, None]
    assert values(spark, [("2024-05-06T10:00:00Z",), ("2024-05-06 x",)], "s string", dates.day_key(F.col("s"))) == [("2024-05-06",)] * 2


@pytest.mark.parametrize(("mid", "days", "want"), [(D(2024, 7, 1), 15, (D(2024, 6, 24), D(2024, 7, 8))), (D(2024, 1, 3), 15, (D(2024, 1, 1), D(2024, 1, 15))), (D(2024, 12, 30), 30, (D(2024, 12, 2), D(2024, 12, 31)))])
def test_centred_window(spark, mid, days, want):
    got = values(spark, [(mid, days, 2024)], "m date, d int, s int", *dates.centred_window(F.col("m"), F.col("d"), F.col("s")))
    assert got == [want]


def test_projection_of_known_point(spark):
    """The central meridian keeps its easting, and the equator its northing; a known place within a metre."""
    got = values(spark, [(9.0, 0.0), (11.320308, 47.116171)], "lon double, lat double", *raster.to_utm(F.col("lon"), F.col("lat")))
    assert got[0] == pytest.approx((500_000, 0), abs=1e-6)
    # independent: meridian arc by numerical integration plus the transverse series of Snyder
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    lat, lam = math.radians(47.116171), math.radians(11.320308 - 9)
    n_steps = 20000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * lat / n_steps) ** 2) ** 1.5 for k in range(n_steps)) * lat / n_steps
    nu, t, ep2 = a / math.sqrt(1 - e2 * math.sin(lat) ** 2), math.tan(lat) ** 2, e2 / (1 - e2)
    c, aa = ep2 * math.cos(lat) ** 2, lam * math.cos(lat)
    east = 500_000 + 0.9996 * nu * (aa + (1 - t + c) * aa**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * aa**5 / 120)
    north = 0.9996 * (arc + nu * math.tan(lat) * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * aa**4 / 24))
    assert got[1] == pytest.approx((east, north), abs=0.5)


def test_readers(spark, tmp_path):
    (tmp_path / "g.csv").write_text("# a comment\ndate,year,doy,gcc_mean,gcc_90,outlierflag_gcc_90\n2024-01-01,2024,1,0.3,0.4,\n2024-01-02,2024,2,0.3,NA,\n2024-01-03,2024,3,0.3,0.5,1\n2025-01-01,2025,1,0.3,0.4,0\n")
    got = readers.ground_truth(spark, str(tmp_path / "g.csv"), "2024-01-01", "2024-12-31").collect()
    assert [(r.date, r.greenness_index) for r in got] == [(D(2024, 1, 1), 0.4)]
    assert readers.series(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "s.json").write_text('[{"date": "2024-01-01", "ndvi": 0.5}, {"date": "2024-01-02"}]')
    assert [(r.date, r.ndvi) for r in readers.series(spark, str(tmp_path / "s.json")).collect()] == [("2024-01-01", 0.5), ("2024-01-02", None)]
    (tmp_path / "sites.json").write_text('{"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [11.3, 47.1]}, "properties": {"sitename": "a", "seasons": {"2020": {}, "2024": {}, "all": {}}}}]}')
    got = sorted((r.site, r.lat, r.lon, r.season) for r in readers.sites(spark, str(tmp_path / "sites.json")).collect())
    assert got == [("a", 47.1, 11.3, 2020), ("a", 47.1, 11.3, 2024)]
    files = spark.createDataFrame([("d/b_20240101_REFL.tif",), ("d/a_20240101_REFL.tif",), ("d/a_20240101_DIST_CLOUD.tif",), ("d/x.tif",)], "path string")
    assert [(r.date, r.filename) for r in readers.scenes(files).collect()] == [(D(2024, 1, 1), "a_20240101_REFL.tif")]
    assert readers.band_names(["x", "B8A", "B02", "crs"]) == ["B02", "B8A"]
