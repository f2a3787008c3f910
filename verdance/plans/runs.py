"""Queries of whole runs: all scenarios of all sites from stacks to metrics, with every baseline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import phenology, products, raster, screening, series
from ..operators.run import Run
from ..session import shared_folder
from ..sinks import writers
from ..sinks.versions import Store
from ..sources import readers, tiles
from . import bindings as b
from .catalogue import _WHITTAKER, BUNDLE, DAYS_OF, query, r6, sql
from .products import _DOWN, _NAMED, _excluded, _named
from .stages import _GCC, _SCENARIOS, _SOUND, _STACK, _one, _stack_day

DAYS_OF |= {"site_metrics": ("first_day", "last_day"), "nearest_in_season": ("target", "nearest_day"), **dict.fromkeys(("cropped_scenarios", "smoothed_baselines", "grown_composites", "screened_scenes", "ordered_listing"), ("date",))}


def _run(spark: SparkSession, sf_dir: str) -> Run:
    """Eight sites of 2024; the truth is that of the orders' days of the year, the same for all sites."""
    one, day = _one(spark, sf_dir), F.dayofyear("date")
    fine = one.filter(day % 3 == 0).select("*", (F.abs("b02") * 40).alias("distance"), (day % 5 == 0).alias("excluded_aggressive"), (day % 4 == 0).alias("excluded_nonaggressive"))
    mean = lambda x, y: ((F.col(x) + F.col(y)) / 2).alias(x)
    coarse = one.select("site", "row", "col", "date", mean("b02", "b03"), mean("b03", "b04"), mean("b04", "b8a"), mean("b8a", "b02"))
    of_year = F.date_add(F.lit("2024-01-01").cast("date"), (F.dayofyear("o_orderdate") - 1).cast("int"))
    truth = b.table(spark, sf_dir, "orders").groupBy(of_year.alias("date")).agg((F.avg("o_totalprice") / 499979).alias("value"), F.min("o_orderkey").alias("pos"))
    each = truth.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("site"), "date", "value", "pos")
    return Run(fine, coarse, each, F.lit(1), F.lit(2))


_NEAR = "row BETWEEN 0 AND 2 AND col BETWEEN 1 AND 3"
_SERIES = [
    *_SCENARIOS,
    f"shown AS (SELECT site, scenario, date, row, col, coalesce(itb, {_GCC}) AS value, greatest(b02, b03, b04, b8a, itb, {_GCC}) > 0.001 AS valid FROM wide)",
    "box AS (SELECT site, scenario, date, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM shown WHERE valid GROUP BY 1, 2, 3)",
    f"fusion_series AS (SELECT site, scenario AS name, date, avg(value) AS value FROM shown JOIN box USING (site, scenario, date) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 AND {_NEAR} GROUP BY 1, 2, 3)",
    f"fine_means AS (SELECT site, date, " + ", ".join(f"avg({x}) FILTER ({_SOUND}) AS {x}" for x in raster.BANDS) + f" FROM one WHERE dayofyear(date) % 3 = 0 AND {_NEAR} GROUP BY 1, 2)",
    f"fine_series AS (SELECT site, date, {_GCC} AS value FROM fine_means)",
    f"coarse_series AS (SELECT c.site, 's3_' || strategy AS name, c.date, avg({_GCC}) AS value FROM coarse c JOIN box x ON x.site = c.site AND x.date = c.date AND x.scenario = strategy || '_sigma20' WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 AND {_NEAR} GROUP BY 1, 2, 3)",
    "clear AS (SELECT site, strategy, date, value FROM fine_series, strategies WHERE dayofyear(date) % CASE WHEN strategy = 'aggressive' THEN 5 ELSE 4 END <> 0)",
    _WHITTAKER.replace("obs AS (SELECT scenario, date, value FROM ser WHERE day(date) % 3 <> 0)", "obs AS (SELECT site || '|' || strategy AS scenario, date, value FROM clear WHERE value IS NOT NULL)"),
    "smooth AS (SELECT CAST(split_part(scenario, '|', 1) AS BIGINT) AS site, 's2_whittaker_' || split_part(scenario, '|', 2) AS name, CAST(d0 + CAST(i AS INT) AS DATE) AS date, x AS value FROM back WHERE n >= 3 AND scenario IN (SELECT scenario FROM obs GROUP BY scenario HAVING count(*) >= 2))",
]


@query(sql(_SERIES, "SELECT s.site, s.scenario, s.date, CAST(count(*) AS BIGINT) AS n, " + r6("avg(s.value) AS greenness_index") + " FROM shown s JOIN box USING (site, scenario, date) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1 GROUP BY 1, 2, 3").replace("WITH ", "WITH RECURSIVE ", 1))
def cropped_scenarios(spark, sf_dir):
    """Every scenario's scenes cut to their valid extent: pixels left and their mean greenness."""
    return _run(spark, sf_dir).cropped.groupBy("site", "scenario", "date").agg(F.count("*").alias("n"), F.avg("greenness_index").alias("greenness_index"))


@query(sql(_SERIES, "SELECT site, name, date, " + r6("value") + " FROM smooth").replace("WITH ", "WITH RECURSIVE ", 1))
def smoothed_baselines(spark, sf_dir):
    rows = _run(spark, sf_dir).candidates.filter(F.col("name").startswith("s2_whittaker"))
    return rows.select("site", "name", "date", "value")


_CANDIDATES = """candidates AS (
  SELECT site, 'temporal' AS section, name, date, value FROM fusion_series UNION ALL SELECT site, 'baseline', name, date, value FROM coarse_series UNION ALL SELECT site, 'baseline', name, date, value FROM smooth
  UNION ALL SELECT site, 'baseline', 's2', date, value FROM fine_series UNION ALL SELECT site, 'baseline', 's2_cloudfree_' || strategy, date, value FROM clear),
truth AS (SELECT CAST(DATE '2024-01-01' + CAST(dayofyear(o_orderdate) - 1 AS INT) AS DATE) AS date, avg(o_totalprice) / 499979 AS value FROM orders GROUP BY 1),
pairs AS (SELECT site, section, name, date, c.value AS pred, t.value AS truth FROM candidates c JOIN truth t USING (date) WHERE c.value IS NOT NULL)"""


@query(sql([*_SERIES, _CANDIDATES, f"found AS (SELECT site, section, name, {BUNDLE} FROM pairs GROUP BY 1, 2, 3)"], f"SELECT site, section, name, {r6('pearson_r', 'nse AS r_squared', 'rmse', 'mae', 'nrmse', 'nse', 'nse AS nse_pc')}, n_samples, first_day, last_day, {r6('residual_mean', 'residual_std')} FROM found WHERE n_samples >= 2").replace("WITH ", "WITH RECURSIVE ", 1))
def site_metrics(spark, sf_dir):
    """The metrics of all scenarios, fused, cropped and sampled about the site, and of all baselines."""
    return _run(spark, sf_dir).metrics


@query()
def metrics_document(spark, sf_dir) -> DataFrame:
    """The same metrics as one document per site."""
    return _run(spark, sf_dir).document


# -- products that grow, windows of tiles, products of a season


@query(sql([b.PX, _NAMED, *_DOWN], "SELECT site, date, row, col, " + r6(*[f"avg(nullif({x}, 0)) OVER w AS {x}" for x in raster.BANDS]) + " FROM coarse WINDOW w AS (PARTITION BY site, row, col ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def grown_composites(spark, sf_dir):
    """Coarse composites of two thirds of the scenes, grown by the rest: the same as made at once."""
    rows = _named(spark, sf_dir)
    folder = f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}"
    composites, smoothed = (Store(spark, f"{folder}/{n}", ["site", "date"]) for n in ("composites", "smoothed"))
    for part in (rows.filter("scene % 3 <> 0"), rows):
        products.grow_coarse(composites, smoothed, part.drop("scene"), _excluded(rows), (4, 4), (2, 2))
    return smoothed.read().select("site", "date", "row", "col", *raster.BANDS)


@query(sql([b.PX, "mosaic AS (SELECT scene // 256 AS scene, (scene // 16) % 16 * 4 + row AS row, scene % 16 * 4 + col AS col, b02, b03, b04, b8a FROM px)"], "SELECT scene, CAST(row AS INT) AS row, CAST(col AS INT) AS col, " + r6(*raster.BANDS) + " FROM mosaic WHERE row BETWEEN 10 AND 25 AND col BETWEEN 6 AND 17"))
def tile_window(spark, sf_dir):
    """A window of mosaics of 16 x 16 tiles, read from tiles laid out along the curve."""
    key = F.col("vec_id")
    laid = b.table(spark, sf_dir, "embeddings").select(F.floor(key / 256).alias("scene"), (F.floor(key / 16) % 16).cast("int").alias("tile_row"), (key % 16).cast("int").alias("tile_col"), F.col("embedding").alias("bands"))
    path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    tiles.write_tiles(laid, path, ["scene"])
    return tiles.read_window(spark, path, ["scene"], 10, 25, 6, 17, 4, 4)


@query(sql([b.ACQ, "o AS (SELECT DISTINCT o_custkey % 10 AS site, CAST(1995 + o_orderkey % 5 AS INT) AS season, CAST(o_orderdate AS DATE) AS target FROM orders)",
            "have AS (SELECT site, CAST(year(date) AS INT) AS season, CASE source WHEN 'O' THEN 'fine' ELSE 'coarse' END AS kind, date, min(filename) AS filename FROM acq WHERE site < 10 GROUP BY 1, 2, 3, 4)",
            "best AS (SELECT o.*, kind, date, filename, abs(date - target) AS d, row_number() OVER (PARTITION BY o.site, o.season, target, kind ORDER BY abs(date - target), date, filename) AS k FROM o JOIN have USING (site, season) WHERE abs(date - target) <= 365)"],
           "SELECT site, season, target, kind, date AS nearest_day, filename AS nearest_name, CAST(d AS INT) AS distance FROM best WHERE k = 1"))
def nearest_in_season(spark, sf_dir):
    """For each site, season and day asked for, the nearest product of both kinds within the season."""
    targets = b.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("site"), (1995 + F.col("o_orderkey") % 5).cast("int").alias("season"), F.col("o_orderdate").cast("date").alias("target")).distinct()
    have = b.acq(spark, sf_dir).filter("site < 10").select("site", F.when(F.col("source") == "O", "fine").otherwise("coarse").alias("kind"), "date", "filename")
    return series.nearest_in_season(targets, have, ["site"], ["fine", "coarse"])


# -- from rasters to screening, ordered listings, small lookups and documents

_SAMPLED = f"""sampled AS (
  SELECT site, CASE WHEN scene % 3 = 0 THEN 'F' ELSE 'O' END AS source, date, 'scene' || lpad(CAST(scene AS VARCHAR), 9, '0') AS filename, CAST(date - DATE '1970-01-01' AS INT) AS day,
    avg(CASE WHEN {_SOUND} THEN (b8a - b04) / (b8a + b04) END) AS ndvi, {", ".join(f"avg(CASE WHEN {_SOUND} THEN {x} END) AS {x}" for x in raster.BANDS)} FROM bright WHERE {_NEAR} GROUP BY site, scene, date),
framed AS (SELECT *, count(ndvi) OVER w AS neighbours, max(ndvi) OVER w AS window_max FROM sampled WINDOW w AS (PARTITION BY site, source ORDER BY day RANGE BETWEEN 14 PRECEDING AND 14 FOLLOWING)),
flagged AS (SELECT *, CASE WHEN ndvi IS NULL OR b02 < 0.55 THEN true WHEN neighbours < 3 THEN false ELSE ndvi < window_max - 0.15 AND ndvi < 0.3 END AS excluded_aggressive,
  CASE WHEN ndvi IS NULL OR b02 < 0.55 THEN true WHEN neighbours < 3 THEN false ELSE ndvi < window_max - 0.25 AND ndvi < 0.2 END AS excluded_nonaggressive FROM framed)"""


@query(sql([b.PX, b.BRIGHT, _SAMPLED], "SELECT site, source, date, filename, " + r6("ndvi", *raster.BANDS) + ", excluded_aggressive, excluded_nonaggressive FROM flagged"))
def screened_scenes(spark, sf_dir):
    """Acquisition tables made from rasters: a site's pixel from its position, the sample about it, and the flags."""
    name = F.concat(F.lit("scene"), F.lpad(F.col("scene").cast("string"), 9, "0"))
    rows = b.bright(b.px(spark, sf_dir)).select("site", F.when(F.col("scene") % 3 == 0, "F").otherwise("O").alias("source"), "date", name.alias("filename"), "row", "col", *raster.BANDS)
    sites = b.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("site")).distinct()
    at = sites.select("site", F.lit(9.0).alias("lon"), F.lit(51.4).alias("lat"))
    grids = sites.select("site", F.lit(499_975.0).alias("x0"), F.lit(5_694_322.9).alias("y0"), F.lit(10.0).alias("dx"), F.lit(10.0).alias("dy"))  # the position is in its second row, third column
    found = screening.screened(rows, at, grids, 0.55)
    return found.select("site", "source", "date", "filename", "ndvi", *raster.BANDS, "excluded_aggressive", "excluded_nonaggressive")


@query(sql([b.ACQ], "SELECT pos, site, date, filename, row_number() OVER (ORDER BY date, filename, pos, site) - 1 AS position FROM acq"))
def ordered_listing(spark, sf_dir):
    """All acquisitions by day, then name: sorted over partitions, with the place of each."""
    return series.numbered(b.acq(spark, sf_dir).select("pos", "site", "date", "filename"), ["date", "filename", "pos", "site"])


@query("WITH s AS (SELECT n_name AS name, arg_min(n_nationkey, n_nationkey) AS site FROM nation GROUP BY 1) SELECT c_custkey, name, site FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nowhere' ELSE n_name END AS name FROM customer JOIN nation ON n_nationkey = c_nationkey) JOIN s USING (name)")
def site_by_name(spark, sf_dir):
    nations = b.table(spark, sf_dir, "nation")
    named = b.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = named.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "nowhere").otherwise(F.col("n_name")).alias("name"))
    sites = nations.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("site"), F.col("n_nationkey").alias("position"))
    return readers.site_by_name(rows, sites)


_TEXT = "CASE WHEN {0} IS NULL THEN 'null' ELSE '\"' || strftime({0}, '%Y-%m-%d') || '\"' END"


@query(sql([*_STACK, "found AS (SELECT scenario AS site, season, " + f"{_stack_day('up')} AS green_up, {_stack_day('down')} AS green_down FROM hits)"], "SELECT site, season, '{\"green_up_50pct_date\":' || " + _TEXT.format("green_up") + " || ',\"green_down_50pct_date\":' || " + _TEXT.format("green_down") + " || '}' AS document FROM found"))
def phenology_sidecars(spark, sf_dir):
    """The documents beside the ground truth of every site and season that it tells."""
    truth = b.ser_long(spark, sf_dir).select(F.col("scenario").alias("site"), "date", "value")
    return writers.sidecar(phenology.season_of_three_years(truth, ["site"]))
