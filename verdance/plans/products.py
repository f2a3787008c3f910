"""Queries of the end-to-end products and of the smaller operators beside them, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, indices
from ..operators import gap, products, raster, screening, series
from . import bindings as b
from .catalogue import _FLAGS, _WHITTAKER, BUNDLE, DAYS_OF, _flagged, query, r6, sql

DAYS_OF |= {
    **dict.fromkeys("day_counts prepare_coarse cropped_triples screening_table".split(), ("date",)),
    "periods": ("first", "last"),
    "baseline_metrics": ("first_day", "last_day"),
    "gap_whittaker": ("withheld_date", "prediction_date"),
}

# -- metrics of a site with all its baselines

_TRUTH = "truth AS (SELECT date, value FROM ser_long WHERE scenario = '1-URGENT')"
_GCC = "CASE WHEN b02 >= 0 AND b03 >= 0 AND b04 >= 0 AND b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END"
_BASELINE_SERIES = f"""series AS (
  SELECT site, unnest(list_filter([CASE WHEN source = 'O' THEN 's2' END, CASE WHEN source = 'O' AND NOT excluded_aggressive THEN 's2_cloudfree_aggressive' END, CASE WHEN source = 'F' AND NOT excluded_aggressive THEN 's3_aggressive' END,
    CASE WHEN source = 'O' AND NOT excluded_nonaggressive THEN 's2_cloudfree_nonaggressive' END, CASE WHEN source = 'F' AND NOT excluded_nonaggressive THEN 's3_nonaggressive' END], lambda x: x IS NOT NULL)) AS baseline, date, {_GCC} AS value, pos FROM flagged),
firsts AS (SELECT site, baseline, date, arg_min_null(value, pos) AS value FROM series GROUP BY 1, 2, 3),
pairs AS (SELECT site, baseline, date, f.value AS pred, t.value AS truth FROM firsts f JOIN truth t USING (date) WHERE f.value IS NOT NULL AND t.value IS NOT NULL)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    blue, green, red, _ = (F.col(c) for c in raster.BANDS)
    flagged = _flagged(spark, sf_dir).withColumn("value", indices.gcc(blue, green, red))
    return products.baselines(flagged, F.col("source") == "O", ["site"], False)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.ser_long(spark, sf_dir).filter("scenario = '1-URGENT'").select("date", "value", "pos")


@query(sql([b.ACQ, _FLAGS, b.SER_LONG, _TRUTH, _BASELINE_SERIES, f"m AS (SELECT site, baseline, {BUNDLE} FROM pairs GROUP BY 1, 2)"],
       f"SELECT site, baseline, {r6('pearson_r', 'nse AS r_squared', 'rmse', 'mae', 'nrmse', 'nse', 'nse AS nse_pc')}, n_samples, first_day, last_day, {r6('residual_mean', 'residual_std')} FROM m WHERE n_samples >= 2"))
def baseline_metrics(spark, sf_dir):
    return products.scored(_candidates(spark, sf_dir), _truth(spark, sf_dir), ["site"], "baseline")


_GAP_WHITTAKER = _WHITTAKER.replace("FROM ser WHERE day(date) % 3 <> 0", "FROM ser WHERE day(date) % 3 <> 0 AND date <> DATE '2024-01-10'")


@query("WITH RECURSIVE " + b.SER + ",\n" + _GAP_WHITTAKER + "\nSELECT scenario, 15 AS gap_days, DATE '2024-01-10' AS withheld_date, DATE '2024-01-10' AS prediction_date, round(x, 6) + 0.0 AS whittaker FROM back WHERE d0 + CAST(i AS INT) = DATE '2024-01-10'")
def gap_whittaker(spark, sf_dir):
    rows, day = b.ser(spark, sf_dir), F.lit("2024-01-10").cast("date")
    entries = rows.select("scenario").distinct().select("scenario", F.lit(15).alias("gap_days"), day.alias("withheld_date"), day.alias("prediction_date"))
    return gap.baseline_without(rows.filter(F.dayofmonth("date") % 3 != 0), entries, ["scenario"])


# -- prepared stacks

_NAMED = """named AS (SELECT scene % 2 AS site, date, 'scene' || lpad(CAST(scene AS VARCHAR), 9, '0') AS filename, scene, row, col, b02, b03, b04, b8a FROM px)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("scene"), F.lpad(F.col("scene").cast("string"), 9, "0"))
    return b.px(spark, sf_dir).select((F.col("scene") % 2).alias("site"), "date", name.alias("filename"), "scene", "row", "col", *raster.BANDS)


def _excluded(rows: DataFrame) -> DataFrame:
    return rows.filter("scene % 5 = 0").select("filename")


def _kernel(x: str) -> str:
    return f"(CASE WHEN {x} < 1 THEN 1.5 * {x} ** 3 - 2.5 * {x} ** 2 + 1 WHEN {x} < 2 THEN -0.5 * {x} ** 3 + 2.5 * {x} ** 2 - 4 * {x} + 2 ELSE 0 END)"


_AT = "(abs((t.r + 0.5::DOUBLE) * 2 - 0.5 - d.row) / 2)", "(abs((t.c + 0.5::DOUBLE) * 2 - 0.5 - d.col) / 2)"
_DOWN = [
    "kept AS (SELECT * FROM named WHERE scene % 5 <> 0)", "many AS (SELECT site, date, min(filename) <> max(filename) AS several FROM kept GROUP BY 1, 2)",
    "daily AS (SELECT k.site, k.date, row, col, " + ", ".join(f"avg(CASE WHEN NOT several OR abs(b02 + b03 + b04 + b8a) / 4 < 5 THEN {x} END) AS {x}" for x in raster.BANDS) + " FROM kept k JOIN many m USING (site, date) GROUP BY 1, 2, 3, 4)",
    f"weighed AS (SELECT site, date, t.r, t.c, {_kernel(_AT[0])} * {_kernel(_AT[1])} AS w, b02, b03, b04, b8a FROM daily d, (SELECT a.r, o.c FROM (VALUES (0), (1)) a(r), (VALUES (0), (1)) o(c)) t)",
    "coarse AS (SELECT site, date, r AS row, c AS col, " + ", ".join(f"sum(w * {x}) / sum(w) AS {x}" for x in raster.BANDS) + " FROM weighed GROUP BY 1, 2, 3, 4)",
]


@query(sql([b.PX, _NAMED, *_DOWN], "SELECT site, date, row, col, " + r6(*[f"avg(nullif({x}, 0)) OVER w AS {x}" for x in raster.BANDS]) + " FROM coarse WINDOW w AS (PARTITION BY site, row, col ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def prepare_coarse(spark, sf_dir):
    rows = _named(spark, sf_dir)
    return products.prepare_coarse(rows.drop("scene"), _excluded(rows), (4, 4), (2, 2))


@query(sql([b.PX, """fused AS (SELECT scene AS site, date, row, col, CASE WHEN b02 > 0.15 THEN b02 END AS value FROM px),
box AS (SELECT site, date, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM fused WHERE value > 0.001 GROUP BY 1, 2),
fine AS (SELECT scene AS site, date, row, col, b03 AS value FROM px WHERE scene % 3 <> 0), coarse AS (SELECT scene AS site, date, row // 2 AS row, col // 2 AS col, avg(b04) AS value FROM px WHERE scene % 4 <> 0 GROUP BY 1, 2, 3, 4)"""],
       "SELECT f.site, f.date, f.row - r0 AS row, f.col - c0 AS col, " + r6("f.value AS fused", "n.value AS fine", "k.value AS coarse") + """ FROM fused f JOIN box USING (site, date)
LEFT JOIN fine n ON n.site = f.site AND n.date = f.date AND n.row = f.row AND n.col = f.col LEFT JOIN coarse k ON k.site = f.site AND k.date = f.date AND k.row = f.row // 2 AND k.col = f.col // 2
WHERE f.row BETWEEN r0 AND r1 AND f.col BETWEEN c0 AND c1"""))  # fmt: skip
def cropped_triples(spark, sf_dir):
    rows = b.px(spark, sf_dir).withColumn("site", F.col("scene"))
    cell = ["site", "date", "row", "col"]
    fused = rows.select(*cell, F.when(F.col("b02") > 0.15, F.col("b02")).alias("value"))
    fine = rows.filter("scene % 3 <> 0").select(*cell, F.col("b03").alias("value"))
    half = rows.filter("scene % 4 <> 0").groupBy("site", "date", F.floor(F.col("row") / 2).cast("int").alias("_r"), F.floor(F.col("col") / 2).cast("int").alias("_c")).agg(F.avg("b04").alias("value"))
    coarse = half.select("site", "date", F.col("_r").alias("row"), F.col("_c").alias("col"), "value")
    return products.cropped(fused, fine, coarse, 2, F.col("value") > raster.VALID)


@query(sql([b.PX, f"weighed AS (SELECT scene, t.r, t.c, {_kernel(_AT[0])} * {_kernel(_AT[1])} AS w, CASE WHEN b02 > -0.2 THEN b02 END AS b02, b03 FROM px d, (SELECT a.r, o.c FROM (VALUES (0), (1)) a(r), (VALUES (0), (1)) o(c)) t)"],
       "SELECT scene, r AS row, c AS col, " + r6("sum(w * b02) / nullif(sum(w) FILTER (b02 IS NOT NULL), 0) AS b02", "sum(w * b03) / sum(w) AS b03") + " FROM weighed GROUP BY 1, 2, 3"))
def coarser_cubic(spark, sf_dir):
    rows = b.px(spark, sf_dir).withColumn("b02", F.when(F.col("b02") > -0.2, F.col("b02")))
    return raster.resample_to(rows, ["scene"], (4, 4), (2, 2), ["b02", "b03"], "cubic")


_THIRDS = "greatest(0.0::DOUBLE, 1 - abs((t.{0} + 0.5::DOUBLE) * 4 / 3 - 0.5 - d.{1}) / (4.0::DOUBLE / 3))"


@query(sql([b.PX, f"weighed AS (SELECT scene, t.r, t.c, {_THIRDS.format('r', 'row')} * {_THIRDS.format('c', 'col')} AS w, b04 FROM px d, (SELECT a.r, o.c FROM (VALUES (0), (1), (2)) a(r), (VALUES (0), (1), (2)) o(c)) t)"],
       "SELECT scene, r AS row, c AS col, " + r6("sum(w * b04) / sum(w) AS b04") + " FROM weighed GROUP BY 1, 2, 3"))
def other_grid_bilinear(spark, sf_dir):
    return raster.resample_to(b.px(spark, sf_dir), ["scene"], (4, 4), (3, 3), ["b04"])


@query(sql([b.PX], "SELECT scene, " + r6(*[f"nullif({x}, 0) AS {x}" for x in raster.BANDS]) + " FROM px WHERE row = scene % 5 AND col = scene % 3 AND scene % 5 BETWEEN 0 AND 3"))
def pixel_sample(spark, sf_dir):
    row, col = (F.col("scene") % 5).cast("int"), (F.col("scene") % 3).cast("int")
    return raster.pixel_sample(b.px(spark, sf_dir).filter(raster.in_grid(row, col, 4, 4)), ["scene"], row, col, list(raster.BANDS))


@query(sql([b.PX], "SELECT scene, row, col, " + r6("CASE WHEN scene % 2 = 0 THEN CASE WHEN b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END ELSE b02 END AS gcc") + ", scene % 2 = 0 AS enough FROM px"))
def fused_gcc(spark, sf_dir):
    bands = F.when(F.col("scene") % 2 == 0, F.array(*raster.BANDS)).otherwise(F.array("b02"))
    return b.px(spark, sf_dir).select("scene", "row", "col", indices.gcc_of_bands(bands).alias("gcc"), indices.enough_bands(bands).alias("enough"))


_NEAR = "FROM px WHERE row BETWEEN 0 AND 2 AND col BETWEEN 1 AND 3 GROUP BY scene"


@query(sql([b.PX], "SELECT scene, " + r6("avg(CASE WHEN b04 > 0 AND b8a > 0 THEN (b8a - b04) / (b8a + b04) END) AS ndvi", "avg(CASE WHEN least(b02, b03, b04) >= 0 AND b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END) AS greenness_index", *[f"avg(CASE WHEN b04 > 0 AND b8a > 0 THEN {x} END) AS {x}" for x in raster.BANDS]) + " " + _NEAR))
def site_series(spark, sf_dir):
    return products.site_bands(b.px(spark, sf_dir), ["scene"], F.lit(1), F.lit(2))


# -- days, names, counts, text


@query(sql([b.ACQ], "SELECT site, source, date, count(*) AS n FROM acq GROUP BY 1, 2, 3"))
def day_counts(spark, sf_dir):
    return series.day_counts(b.acq(spark, sf_dir), ["site", "source"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE make_date(2020, 1, 1) END AS first, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2020-06-30' ELSE make_date(2020, 12, 31) END AS last FROM orders")
def periods(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("/2020-06-30"))).when(F.col("o_orderkey") % 3 == 1, day)
    first, last = dates.period(text, F.lit(2020))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2000 + s_suppkey % 24 ELSE 1999 END AS INT) AS season FROM supplier")
def path_seasons(spark, sf_dir):
    key = F.col("s_suppkey")
    path = F.when(key % 2 == 0, F.concat(F.lit("data/site/"), (2000 + key % 24).cast("string"), F.lit("/2031/x.json"))).otherwise(F.concat(F.lit("data/20245/"), key.cast("string"), F.lit("x/y.json")))
    return b.table(spark, sf_dir, "supplier").select("s_suppkey", dates.season_of_path(path, F.lit(1999)).alias("season"))


@query(sql([b.ACQ], "SELECT pos, CASE pos % 4 WHEN 0 THEN strftime(date, '%Y%m%d') || '_ndvi.geotiff' WHEN 1 THEN 'composite_' || strftime(date, '%Y%m%d') || '.geotiff' WHEN 2 THEN strftime(date, '%Y%m%d') || '_ndvi.geotiff' ELSE 'x.geotiff' END AS output FROM acq"))
def output_names(spark, sf_dir):
    day, kind = F.date_format("date", "yyyyMMdd"), F.col("pos") % 4
    name = F.when(kind == 0, F.col("filename")).when(kind == 1, F.concat(F.lit("composite_"), day, F.lit(".tif"))).when(kind == 2, F.concat(F.lit("REFL_"), day, F.lit(".tif"))).otherwise(F.lit("x.geotiff"))
    return b.acq(spark, sf_dir).select("pos", dates.index_name(name).alias("output"))


@query("SELECT DISTINCT 'site' || (l_suppkey % 7) AS site, CAST(year(l_shipdate) AS INT) AS season FROM lineitem")
def distinct_site_seasons(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("site"), (F.col("l_suppkey") % 7).cast("string")).alias("site"), F.year("l_shipdate").alias("season")).distinct()


@query("""SELECT item_id, replace(replace(replace(replace(replace('<b a="' || text || '">&''</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html FROM benchmark""")
def escaped_html(spark, sf_dir):
    text = F.concat(F.lit('<b a="'), F.col("text"), F.lit("\">&'</b>"))
    return b.table(spark, sf_dir, "benchmark").select("item_id", indices.escaped(text).alias("html"))


@query("SELECT s_suppkey, " + r6("5 + s_nationkey % 8 / 2.0::DOUBLE AS lon", "40 + s_suppkey % 20::DOUBLE AS lat") + " FROM supplier")
def utm_round_trip(spark, sf_dir):
    lon, lat = 5 + F.col("s_nationkey") % 8 / 2.0, (40 + F.col("s_suppkey") % 20).cast("double")
    out = raster.to_lonlat(*raster.to_utm(lon, lat))
    return b.table(spark, sf_dir, "supplier").select("s_suppkey", out[0].alias("lon"), out[1].alias("lat"))


@query(sql([b.ACQ, _FLAGS], "SELECT site, source, date, filename, " + r6("ndvi") + ", excluded_aggressive, excluded_nonaggressive FROM flagged WHERE ndvi IS NOT NULL OR b02 IS NOT NULL"))
def screening_table(spark, sf_dir):
    flagged = _flagged(spark, sf_dir).filter("ndvi is not null or b02 is not null")
    return flagged.select("site", "source", F.col("date").cast("string").alias("date"), "filename", "ndvi", *[f"excluded_{s}" for s in screening.STRATEGIES])
