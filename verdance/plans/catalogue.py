"""All registered queries and their SQL counterparts: every operator applied to a binding of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, indices
from ..operators import fusion, gap, metrics, phenology, raster, reports, screening, series, smoothing
from ..sinks import writers
from ..sources import readers
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TRUTH = "view"


#: Result columns that hold dates, by query; both engines give them as text.
DAYS_OF = {
    **dict.fromkeys("report_pivot dedupe_first dedupe_last dedupe_first_valid export_full_outer date_set_operations day_grid_interpolation moving_average_5 increment_counter precedence_merge whittaker same_day_composite weighted_fusion catalogue_first_items".split(), ("date",)),
    "temporal_metrics": ("first_day", "last_day"),
    "filename_dates": ("parsed",),
    "day_keys": ("round_trip",),
    "centred_windows": ("window_start", "window_end"),
    "nearest_acquisition": ("target", "nearest_day"),
    "gap_manifest": ("midpoint_date", "prediction_date", "window_start", "window_end", "withheld_date"),
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name; doubles are rounded to six places and dates given as text, as in its SQL."""

    def register(f: Query) -> Query:
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c).cast("string") if t == "date" else F.col(c) for c, t in out.dtypes])

        QUERIES[f.__name__] = rounded
        if sql:
            days = sorted(DAYS_OF.get(f.__name__, ()))
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM (\n{sql}\n)" if days else sql
        return rounded

    return register


def sql(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def r6(*named: str) -> str:
    """'expr AS name' with the expression rounded."""
    out = []
    for x in named:
        expr, _, name = x.rpartition(" AS ")
        out.append(f"round({expr or name}, 6) + 0.0 AS {name}")
    return ", ".join(out)


# -- temporal agreement

PAIRS = f"""firsts AS (SELECT scenario, date, arg_min_null(value, pos) AS value FROM ser_user GROUP BY 1, 2),
pairs AS (SELECT c.scenario, c.date, c.value AS pred, t.value AS truth FROM firsts c JOIN firsts t ON t.date = c.date AND t.scenario = '{TRUTH}'
  WHERE c.value IS NOT NULL AND t.value IS NOT NULL)"""
BUNDLE = """CASE WHEN stddev_pop(pred) * stddev_pop(truth) > 0 THEN covar_pop(pred, truth) / (stddev_pop(pred) * stddev_pop(truth)) END AS pearson_r,
  CASE WHEN var_pop(truth) > 0 THEN 1 - sum((truth - pred) ** 2) / (var_pop(truth) * count(truth)) END AS nse,
  sqrt(avg((truth - pred) ** 2)) AS rmse, avg(abs(truth - pred)) AS mae, sqrt(avg((truth - pred) ** 2)) / avg(truth) AS nrmse, count(*) AS n_samples,
  min(date) AS first_day, max(date) AS last_day, avg(pred - truth) AS residual_mean, stddev_pop(pred - truth) AS residual_std"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.ser_user(spark, sf_dir)
    truth = rows.filter(F.col("scenario") == TRUTH).select("date", "value", "pos")
    return series.match_days(rows, truth, ["scenario"], [])


@query(sql([b.SER_USER, PAIRS, f"m AS (SELECT scenario, {BUNDLE} FROM pairs GROUP BY scenario)"],
       f"SELECT scenario, {r6('pearson_r', 'nse AS r_squared', 'rmse', 'mae', 'nrmse', 'nse', 'nse AS nse_pc')}, n_samples, first_day, last_day, {r6('residual_mean', 'residual_std')} FROM m WHERE n_samples >= 2"))
def temporal_metrics(spark, sf_dir):
    return metrics.temporal_metrics(_pairs(spark, sf_dir), ["scenario"])


@query(sql([b.SER_USER], f"SELECT scenario, {r6('avg(value) AS mean', 'stddev_pop(value) AS std', 'min(value) AS min', 'max(value) AS max')}, count(value) AS n_samples FROM ser_user WHERE value IS NOT NULL GROUP BY scenario"))
def truth_stats(spark, sf_dir):
    return metrics.truth_stats(b.ser_user(spark, sf_dir), ["scenario"])


GRID = "grid(scenario, strategy, sigma, mode) AS (VALUES ('click', 'aggressive', 20, 'bti'), ('purchase', 'aggressive', 30, 'bti'), ('signup', 'aggressive', 20, 'itb'), ('error', 'nonaggressive', 20, 'bti'))"


def _scored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("click", "aggressive", 20, "bti"), ("purchase", "aggressive", 30, "bti"), ("signup", "aggressive", 20, "itb"), ("error", "nonaggressive", 20, "bti")]
    named = spark.createDataFrame(rows, "series string, strategy string, sigma int, mode string")
    scored = metrics.temporal_metrics(_pairs(spark, sf_dir), ["scenario"]).withColumnRenamed("scenario", "series")
    grid = metrics.scenarios(spark).join(named, ["strategy", "sigma", "mode"], "left")
    return grid.join(scored, "series", "left")


_GRID = [b.SER_USER, PAIRS, f"m AS (SELECT scenario, {BUNDLE} FROM pairs GROUP BY scenario HAVING count(*) >= 2)", GRID,
         "whole AS (SELECT s.strategy, g.sigma, o.mode FROM (VALUES ('aggressive'), ('nonaggressive')) s(strategy), (VALUES (20), (30)) g(sigma), (VALUES ('bti'), ('itb')) o(mode))",
         "scored AS (SELECT w.strategy, w.sigma, w.mode, m.* EXCLUDE (scenario) FROM whole w LEFT JOIN grid g ON g.strategy = w.strategy AND g.sigma = w.sigma AND g.mode = w.mode LEFT JOIN m ON m.scenario = g.scenario)"]


@query(sql(_GRID, f"SELECT strategy, mode, {r6('max(nse) FILTER (sigma = 20) - max(nse) FILTER (sigma = 30) AS delta_nse')} FROM scored GROUP BY 1, 2"))
def derived_delta_nse(spark, sf_dir):
    return metrics.derived(_scored_grid(spark, sf_dir), [])


@query(sql(_GRID, "SELECT strategy, CAST(sigma AS INT) AS sigma, " + r6("max(residual_mean) FILTER (mode = 'bti') AS mean_residual_bti", "max(residual_mean) FILTER (mode = 'itb') AS mean_residual_itb") + " FROM scored GROUP BY 1, 2"))
def paired_residual(spark, sf_dir):
    return metrics.paired_residuals(_scored_grid(spark, sf_dir), [])


@query("SELECT s_suppkey AS site, s.strategy, CAST(g.sigma AS INT) AS sigma, o.mode, s.strategy || '_sigma' || g.sigma || CASE WHEN o.mode = 'itb' THEN '_itb' ELSE '' END AS scenario FROM supplier, (VALUES ('aggressive'), ('nonaggressive')) s(strategy), (VALUES (20), (30)) g(sigma), (VALUES ('bti'), ('itb')) o(mode)")
def scenario_grid(spark, sf_dir):
    """All scenarios of every site."""
    return metrics.scenarios_of(b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site")))


@query(sql([b.SER_USER, PAIRS, f"m AS (SELECT scenario, {BUNDLE} FROM pairs GROUP BY scenario HAVING count(*) >= 2)"],
       "SELECT scenario, " + ", ".join(f"coalesce(printf('%.3f', round({e}, 3)), '—') AS {n}" for e, n in (("nse", "r_squared"), ("nrmse", "nrmse"), ("nse", "nse"), ("residual_mean", "mean_residual"))) + " FROM m"))
def report_scenarios(spark, sf_dir):
    return reports.scenario_table(metrics.temporal_metrics(_pairs(spark, sf_dir), ["scenario"]), ["scenario"])


@query(sql([b.SER], "SELECT date, " + r6("max(value) FILTER (scenario = 'view') AS value_view", "max(value) FILTER (scenario = 'click') AS value_click") + " FROM ser GROUP BY date"))
def report_pivot(spark, sf_dir):
    return reports.pivot(b.ser(spark, sf_dir), ["date"], "scenario", ["view", "click"], "value")


_BASELINES = {"click": "s2", "purchase": "s3_aggressive", "signup": "s2_cloudfree_aggressive", "error": "s2_whittaker_aggressive"}


@query(sql([b.SER_USER, PAIRS, "named(scenario, baseline, order_key) AS (VALUES ('click', 's2', 0), ('purchase', 's3_aggressive', 1), ('signup', 's2_cloudfree_aggressive', 2), ('error', 's2_whittaker_aggressive', 3))"],
       f"SELECT baseline, order_key, {r6('sqrt(avg((truth - pred) ** 2)) AS rmse')}, count(*) AS n_samples FROM pairs JOIN named USING (scenario) GROUP BY 1, 2"))
def baseline_union(spark, sf_dir):
    rows, parts = b.ser_user(spark, sf_dir), []
    for scenario, name in _BASELINES.items():
        parts.append(rows.filter(F.col("scenario") == scenario).withColumn("baseline", F.lit(name)))
    everything = parts[0]
    for p in parts[1:]:
        everything = everything.unionByName(p)
    truth = rows.filter(F.col("scenario") == TRUTH).select("date", "value", "pos")
    scored = metrics.temporal_metrics(series.match_days(everything, truth, ["baseline"], []), ["baseline"])
    return reports.baseline_order(scored).select("baseline", "order_key", "rmse", "n_samples")


# -- indices and screening


@query(sql([b.ACQ], f"SELECT pos, {r6(b.NDVI + ' AS ndvi', 'CASE WHEN b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END AS gcc', 'CASE WHEN b04 + b03 + b04 > 0 THEN b03 / (b04 + b03 + b04) ELSE 0 END AS gcc_rgr', 'b8a * 1e6 / 10000 AS reflectance')} FROM acq"))
def index_projection(spark, sf_dir):
    blue, green, red, nir = (F.col(c) for c in raster.BANDS)
    return b.acq(spark, sf_dir).select("pos", indices.ndvi(red, nir).alias("ndvi"), indices.gcc(blue, green, red).alias("gcc"), indices.gcc_rgr(green, red).alias("gcc_rgr"), indices.reflectance(nir * 1e6).alias("reflectance"))


@query(sql([b.PX], "SELECT scene, row, col, " + r6("CASE WHEN b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) ELSE 0 END AS gcc_raster", "CASE WHEN b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END AS gcc_strict") + " FROM px"))
def gcc_rasters(spark, sf_dir):
    blue, green, red, _ = (F.col(c) for c in raster.BANDS)
    return b.px(spark, sf_dir).select("scene", "row", "col", indices.gcc_raster(blue, green, red).alias("gcc_raster"), indices.gcc_strict(blue, green, red).alias("gcc_strict"))


@query(sql([b.ACQ], "SELECT pos, site FROM acq WHERE b02 < 0.01"))
def dark_scene_filter(spark, sf_dir):
    return b.acq(spark, sf_dir).filter(screening.dark(F.col("b02"), screening.DARK_BLUE["S3"])).select("pos", "site")


_FLAGS = f"""seen AS (SELECT *, {b.NDVI} AS ndvi FROM acq),
framed AS (SELECT *, count(ndvi) OVER w AS neighbours, max(ndvi) OVER w AS window_max FROM seen WINDOW w AS (PARTITION BY site, source ORDER BY day RANGE BETWEEN 14 PRECEDING AND 14 FOLLOWING)),
flagged AS (SELECT *, CASE WHEN ndvi IS NULL OR b02 < 0.01 THEN true WHEN neighbours < 3 THEN false ELSE ndvi < window_max - 0.15 AND ndvi < 0.3 END AS excluded_aggressive,
  CASE WHEN ndvi IS NULL OR b02 < 0.01 THEN true WHEN neighbours < 3 THEN false ELSE ndvi < window_max - 0.25 AND ndvi < 0.2 END AS excluded_nonaggressive FROM framed)"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.acq(spark, sf_dir).withColumn("ndvi", indices.ndvi(F.col("b04"), F.col("b8a")))
    return screening.flag_exclusions(rows, screening.DARK_BLUE["S3"])


@query(sql([b.ACQ, _FLAGS], f"SELECT pos, site, source, day, neighbours, {r6('window_max')}, excluded_aggressive, excluded_nonaggressive FROM flagged"))
def preselection_exclusion(spark, sf_dir):
    return _flagged(spark, sf_dir).select("pos", "site", "source", "day", "neighbours", "window_max", "excluded_aggressive", "excluded_nonaggressive")


@query(sql([b.ACQ, _FLAGS], "SELECT source, count(*) AS n, count(*) FILTER (excluded_aggressive) AS n_excluded_aggressive, count(*) FILTER (excluded_nonaggressive) AS n_excluded_nonaggressive FROM flagged GROUP BY source"))
def exclusion_counts(spark, sf_dir):
    return screening.exclusion_counts(_flagged(spark, sf_dir), ("source",))


@query(sql([b.ACQ, _FLAGS], "SELECT pos, site, source FROM flagged WHERE NOT excluded_aggressive"))
def keep_flag_filter(spark, sf_dir):
    return screening.keep(_flagged(spark, sf_dir), "aggressive").select("pos", "site", "source")


@query(sql([b.ACQ, _FLAGS], "SELECT pos, site FROM acq a WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.excluded_nonaggressive AND f.site = a.site AND f.filename = a.filename)"))
def keep_anti_join(spark, sf_dir):
    excluded = _flagged(spark, sf_dir).filter("excluded_nonaggressive")
    return screening.without(b.acq(spark, sf_dir), excluded, ["site", "filename"]).select("pos", "site")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def probe_semi(spark, sf_dir):
    present = b.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.available(b.table(spark, sf_dir, "orders"), present, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def incremental_unseen(spark, sf_dir):
    present = b.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.unseen(b.table(spark, sf_dir, "orders"), present, ["o_orderkey"]).select("o_orderkey")


# -- names and dates


@query(sql([b.ACQ], """SELECT pos, date AS parsed, strftime(date, '%Y-%m-%d') AS iso, strftime(date, '%Y%m%d') AS product, CASE WHEN pos % 2 = 0 THEN CAST(pos % 7 AS VARCHAR) ELSE '0' END AS increment FROM acq"""))
def filename_dates(spark, sf_dir):
    item = F.concat(F.lit("S2A_32UQD_"), F.date_format("date", "yyyyMMdd"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("_"), (F.col("pos") % 7).cast("string"), F.lit("_L2A"))).otherwise(""))
    return b.acq(spark, sf_dir).select("pos", dates.filename_date(F.col("filename")).alias("parsed"), dates.filename_day_or_stem(F.col("filename")).alias("iso"), dates.product_day(F.col("filename")).alias("product"), dates.increment(item).alias("increment"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day_key, CAST(year(o_orderdate) * 1000 + dayofyear(o_orderdate) AS INT) AS year_day, CAST(o_orderdate AS DATE) AS round_trip, CAST(CASE WHEN year(o_orderdate) % 4 = 0 THEN 366 ELSE 365 END AS INT) AS days_in_year FROM orders")
def day_keys(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    code = dates.year_day(day)
    return b.table(spark, sf_dir, "orders").select("o_orderkey", dates.day_key(F.concat(day.cast("string"), F.lit("T10:00:00Z"))).alias("day_key"), code.alias("year_day"), dates.from_year_day(code).alias("round_trip"), dates.days_in_year(F.year(day)).alias("days_in_year"))


@query("""WITH g(gap_days) AS (VALUES (15), (30), (60), (90)), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS mid, make_date(year(o_orderdate), 1, 1) AS y0, make_date(year(o_orderdate), 12, 31) AS y1 FROM orders),
w AS (SELECT *, CAST(mid - gap_days // 2 AS DATE) AS s, CAST(mid + (gap_days - 1 - gap_days // 2) AS DATE) AS e FROM o, g),
x AS (SELECT *, CASE WHEN s < y0 THEN least(y1, CAST(e + CAST(y0 - s AS INT) AS DATE)) ELSE e END AS e1, greatest(s, y0) AS s1, greatest(CAST(e - y1 AS INT), 0) AS late FROM w)
SELECT o_orderkey, CAST(gap_days AS INT) AS gap_days, CASE WHEN late > 0 THEN greatest(y0, CAST(s1 - late AS DATE)) ELSE s1 END AS window_start, least(e1, y1) AS window_end FROM x""")
def centred_windows(spark, sf_dir):
    rows = b.table(spark, sf_dir, "orders").withColumn("gap_days", F.explode(F.array(*[F.lit(g) for g in gap.GAP_DAYS])))
    start, end = dates.centred_window(F.col("o_orderdate").cast("date"), F.col("gap_days"), F.year("o_orderdate"))
    return rows.select("o_orderkey", "gap_days", start.alias("window_start"), end.alias("window_end"))


# -- series


def _dedupe(policy: str, function: str, where: str = "") -> None:
    def run(spark, sf_dir):
        return series.dedupe(b.ser_user(spark, sf_dir), ["scenario", "date"], "value", "pos", policy)

    run.__name__ = f"dedupe_{policy}"
    query(sql([b.SER_USER], f"SELECT scenario, date, {r6(f'{function}(value, pos) AS value')} FROM ser_user {where} GROUP BY 1, 2"))(run)


_dedupe("first", "arg_min_null")
_dedupe("last", "arg_max_null")
_dedupe("first_valid", "arg_min", "WHERE value IS NOT NULL")


@query(sql([b.SER, "a AS (SELECT date, value FROM ser WHERE scenario = 'view' AND day(date) % 3 <> 0)", "g AS (SELECT date, value FROM ser WHERE scenario = 'click' AND day(date) % 3 <> 1)", "c AS (SELECT date, value FROM ser WHERE scenario = 'error' AND day(date) % 2 = 0)"],
       "SELECT date, coalesce('c' || c.value::INT, 'g' || g.value::INT, 'a' || a.value::INT) IS NOT NULL AS named, CASE WHEN c.date IS NOT NULL THEN 'bands' WHEN g.date IS NOT NULL THEN 'gcc' ELSE 'ndvi' END AS filename, " + r6("a.value AS ndvi", "g.value AS greenness_index", "c.value AS b02") + " FROM a FULL JOIN g USING (date) FULL JOIN c USING (date)"))
def export_full_outer(spark, sf_dir):
    rows = b.ser(spark, sf_dir)
    part = lambda s, keep, name: rows.filter((F.col("scenario") == s) & keep).select("date", F.lit(name).alias("filename"), "value")
    day = F.dayofmonth("date")
    a, g, c = part("view", day % 3 != 0, "ndvi"), part("click", day % 3 != 1, "gcc"), part("error", day % 2 == 0, "bands")
    bands = c.select("date", "filename", *[F.col("value").alias(x) for x in raster.BANDS])
    out = series.export_merge(a.withColumnRenamed("value", "ndvi"), g.withColumnRenamed("value", "greenness_index"), bands)
    return out.select("date", F.col("filename").isNotNull().alias("named"), "filename", "ndvi", "greenness_index", "b02")


_DAYS = "a AS (SELECT date FROM ser_long WHERE scenario = '1-URGENT'), c AS (SELECT date FROM ser_long WHERE scenario = '5-LOW')"


def _two_day_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = b.ser_long(spark, sf_dir)
    return rows.filter("scenario = '1-URGENT'").select("date"), rows.filter("scenario = '5-LOW'").select("date")


@query(sql([b.SER_LONG, _DAYS], "SELECT 'both' AS kind, date FROM (SELECT date FROM a INTERSECT SELECT date FROM c) UNION ALL SELECT 'first only', date FROM (SELECT date FROM a EXCEPT SELECT date FROM c) UNION ALL SELECT 'either', date FROM (SELECT date FROM a UNION SELECT date FROM c)"))
def date_set_operations(spark, sf_dir):
    a, c = _two_day_sets(spark, sf_dir)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "date")
    return named(a.intersect(c), "both").unionByName(named(a.subtract(c), "first only")).unionByName(named(a.union(c).distinct(), "either"))


@query(sql([b.SER_LONG, "grid AS (SELECT scenario, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM ser_long GROUP BY scenario)",
            "j AS (SELECT g.scenario, g.date, s.value FROM grid g LEFT JOIN ser_long s ON s.scenario = g.scenario AND s.date = g.date)",
            """n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER b AS d0, last_value(value IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER a AS d1, first_value(value IGNORE NULLS) OVER a AS v1 FROM j
  WINDOW b AS (PARTITION BY scenario ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY scenario ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""],
       "SELECT scenario, date, " + r6("value", "coalesce(value, v0 + (v1 - v0) / (d1 - d0) * (date - d0), v0, v1) AS filled") + " FROM n"))
def day_grid_interpolation(spark, sf_dir):
    rows = b.ser_long(spark, sf_dir)
    grid = series.day_grid(rows, ["scenario"]).join(rows.select("scenario", "date", "value"), ["scenario", "date"], "left")
    return series.interpolate(grid, ["scenario"])


@query(sql([b.SER_LONG], "SELECT scenario, date, " + r6("coalesce(avg(nullif(CASE WHEN day(date) % 5 = 0 THEN 0 ELSE value END, 0)) OVER (PARTITION BY scenario ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS smoothed") + " FROM ser_long"))
def moving_average_5(spark, sf_dir):
    rows = b.ser_long(spark, sf_dir).withColumn("value", F.when(F.dayofmonth("date") % 5 == 0, 0.0).otherwise(F.col("value")))
    return smoothing.moving_average(rows, ["scenario"], "date", "value").select("scenario", "date", "smoothed")


@query(sql([b.ACQ], "SELECT pos, site, date, CAST(row_number() OVER (PARTITION BY site, date ORDER BY pos) - 1 AS INT) AS increment FROM acq"))
def increment_counter(spark, sf_dir):
    return series.increments(b.acq(spark, sf_dir), ["site", "date"], ["pos"]).select("pos", "site", "date", "increment")


@query(sql([b.ACQ, "o AS (SELECT o_orderkey, o_custkey % 10 AS site, CAST(o_orderdate AS DATE) AS target FROM orders)",
            "met AS (SELECT o.*, a.date, a.filename, abs(a.date - o.target) AS d FROM o JOIN (SELECT DISTINCT site, date, filename FROM acq) a ON a.site = o.site AND abs(a.date - o.target) <= 20)",
            "best AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY d, date, filename) AS k FROM met)"],
       "SELECT site, o_orderkey, target, date AS nearest_day, filename AS nearest_name, CAST(d AS INT) AS distance FROM best WHERE k = 1"))
def nearest_acquisition(spark, sf_dir):
    """Every order; orders of one site and day share their nearest acquisition, so the join is of distinct targets."""
    orders = b.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("site"), F.col("o_orderdate").cast("date").alias("target"))
    acquisitions = b.acq(spark, sf_dir).select("site", "date", "filename").filter("site < 10").distinct()
    found = series.nearest(orders.select("site", "target").distinct(), acquisitions, ["site"], ["site"], "target", 20)
    return orders.join(found, ["site", "target"]).select("site", "o_orderkey", "target", "nearest_day", "nearest_name", "distance")


@query(sql([b.SER_LONG, "y3 AS (SELECT scenario, date, value FROM ser_long WHERE day(date) % 2 = 0), y1 AS (SELECT scenario, date, value * 2 AS value FROM ser_long WHERE day(date) % 3 = 0)"],
       "SELECT scenario, date, " + r6("coalesce(y3.value, y1.value) AS value") + " FROM y3 FULL JOIN y1 USING (scenario, date)"))
def precedence_merge(spark, sf_dir):
    rows = b.ser_long(spark, sf_dir).select("scenario", "date", "value")
    day = F.dayofmonth("date")
    return series.precedence_merge(rows.filter(day % 2 == 0), rows.filter(day % 3 == 0).withColumn("value", F.col("value") * 2), ["scenario", "date"])


@query(sql([b.SER_LONG, "d AS (SELECT scenario, date, year(date) AS year, dayofyear(date) AS doy, value FROM ser_long)"],
       "SELECT scenario, CAST(year AS INT) AS year, CAST(doy AS INT) AS doy, " + r6("arg_max(value, date) AS value") + " FROM d WHERE doy <= 365 AND abs(year - 1998) <= 1 GROUP BY scenario, year, doy"))
def three_year_stack(spark, sf_dir):
    return series.three_year_stack(b.ser_long(spark, sf_dir), ["scenario"], F.lit(1998), False)


_WHITTAKER = """obs AS (SELECT scenario, date, value FROM ser WHERE day(date) % 3 <> 0),
span AS (SELECT scenario, min(date) AS d0, max(date) AS d1 FROM obs GROUP BY scenario),
grid AS (SELECT scenario, d0, CAST(d1 - d0 AS INT) + 1 AS n, unnest(range(CAST(d1 - d0 AS INT) + 1)) AS i FROM span),
sys AS (
  SELECT g.scenario, g.d0, g.n, g.i, CASE WHEN o.value IS NULL THEN 0 ELSE 1 END AS w, coalesce(o.value, 0) AS y,
    400.0::DOUBLE * ((g.i < n - 2)::INT + 4 * (g.i >= 1 AND g.i <= n - 2)::INT + (g.i >= 2)::INT) AS h, -800.0::DOUBLE * ((g.i < n - 2)::INT + (g.i >= 1 AND g.i <= n - 2)::INT) AS e, 400.0::DOUBLE * (g.i < n - 2)::INT AS f
  FROM grid g LEFT JOIN obs o ON o.scenario = g.scenario AND o.date = g.d0 + CAST(g.i AS INT)),
fwd AS (
  SELECT scenario, d0, n, i, w + h AS d, e / (w + h) AS up, f / (w + h) AS up2, y AS z, 0.0::DOUBLE AS pd, 0.0::DOUBLE AS pup2, 0.0::DOUBLE AS pz FROM sys WHERE i = 0
  UNION ALL
  SELECT s.scenario, s.d0, s.n, s.i, t.d, (s.e - p.d * p.up * p.up2) / t.d, s.f / t.d, s.y - p.up * p.z - p.pup2 * p.pz, p.d, p.up2, p.z
  FROM fwd p JOIN sys s ON s.scenario = p.scenario AND s.i = p.i + 1, LATERAL (SELECT s.w + s.h - p.d * p.up * p.up - p.pd * p.pup2 * p.pup2 AS d) t),
back AS (
  SELECT scenario, d0, n, i, z / d AS x, 0.0::DOUBLE AS x1 FROM fwd WHERE i = n - 1
  UNION ALL
  SELECT f.scenario, f.d0, f.n, f.i, f.z / f.d - f.up * k.x - f.up2 * k.x1, k.x FROM back k JOIN fwd f ON f.scenario = k.scenario AND f.i = k.i - 1)"""


@query("WITH RECURSIVE " + b.SER + ",\n" + _WHITTAKER + "\nSELECT scenario, CAST(d0 + CAST(i AS INT) AS DATE) AS date, round(x, 6) + 0.0 AS smoothed FROM back")
def whittaker(spark, sf_dir):
    return smoothing.whittaker(b.ser(spark, sf_dir).filter(F.dayofmonth("date") % 3 != 0), ["scenario"])


@query(sql([b.SER, "s AS (SELECT scenario, day(date) AS gap_days, value AS fusion, avg(value) OVER (PARTITION BY scenario) AS baseline FROM ser)"],
       "SELECT scenario, CAST(min(gap_days) FILTER (fusion < baseline) AS INT) AS crossover_days FROM s GROUP BY scenario"))
def crossover(spark, sf_dir):
    rows = b.ser(spark, sf_dir).withColumn("gap_days", F.dayofmonth("date")).withColumnRenamed("value", "fusion").withColumn("baseline", F.avg("fusion").over(Window.partitionBy("scenario")))
    return smoothing.crossover(rows, ["scenario"])


# -- rasters

_DAY_ACQ = "daily AS (SELECT site % 5 AS site, date, pos, b02 * 59.9973::DOUBLE AS b02, b03 * 59.9973::DOUBLE AS b03, b04 * 59.9973::DOUBLE AS b04, b8a * 59.9973::DOUBLE AS b8a FROM acq)"


@query(sql([b.ACQ, _DAY_ACQ, "m AS (SELECT *, count(*) OVER (PARTITION BY site, date) AS many, abs(b02 + b03 + b04 + b8a) / 4 AS level FROM daily)"],
       "SELECT site, date, " + r6(*[f"avg(CASE WHEN many = 1 OR level < 5 THEN {x} END) AS {x}" for x in raster.BANDS]) + " FROM m GROUP BY site, date"))
def same_day_composite(spark, sf_dir):
    rows = b.acq(spark, sf_dir).select((F.col("site") % 5).alias("site"), "date", F.col("pos").alias("acquisition"), *[(F.col(x) * 59.9973).alias(x) for x in raster.BANDS])
    return raster.composite(rows, ["site", "date"])


_VALID = "(b04 > 0 AND b8a > 0)"


@query(sql([b.PX], f"SELECT scene, {r6(f'avg(CASE WHEN {_VALID} THEN (b8a - b04) / (b8a + b04) END) AS ndvi', *[f'avg(CASE WHEN {_VALID} THEN {x} END) AS {x}' for x in raster.BANDS])} FROM px WHERE row BETWEEN 0 AND 2 AND col BETWEEN 1 AND 3 GROUP BY scene"))
def site_sample_3x3(spark, sf_dir):
    return screening.site_sample(b.px(spark, sf_dir), ["scene"], F.lit(1), F.lit(2))


@query(sql([b.PX], "SELECT scene, " + r6("avg(CASE WHEN least(b02, b03, b04) >= 0 AND b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END) AS greenness_index") + " FROM px WHERE row <= 1 AND col <= 1 GROUP BY scene"))
def site_gcc_3x3(spark, sf_dir):
    return screening.site_gcc(b.px(spark, sf_dir), ["scene"], F.lit(0), F.lit(0))


_CROP = "seen AS (SELECT scene, row, col, CASE WHEN b02 > 0.15 THEN b02 END AS b02 FROM px), box AS (SELECT scene, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM seen WHERE b02 > 0.001 GROUP BY scene)"


@query(sql([b.PX, _CROP], "SELECT s.scene, s.row - r0 AS row, s.col - c0 AS col, " + r6("b02") + " FROM seen s JOIN box USING (scene) WHERE s.row BETWEEN r0 AND r1 AND s.col BETWEEN c0 AND c1"))
def valid_extent_crop(spark, sf_dir):
    seen = b.px(spark, sf_dir).select("scene", "row", "col", F.when(F.col("b02") > 0.15, F.col("b02")).alias("b02"))
    return raster.crop(seen, ["scene"], raster.extent(seen, ["scene"], raster.valid(("b02",))))


@query(sql([b.PX], "SELECT scene, CAST(row * 3 + k // 3 AS INT) AS row, CAST(col * 3 + k % 3 AS INT) AS col, " + r6("b02") + " FROM px, range(9) t(k)"))
def nearest_resample(spark, sf_dir):
    return raster.resample_nearest(b.px(spark, sf_dir), ["scene"], 3, ["b02"])


_FINE = "fine AS (SELECT r, c, (r + 0.5::DOUBLE) / 3 - 0.5 AS y, (c + 0.5::DOUBLE) / 3 - 0.5 AS x FROM range(12) a(r), range(12) q(c))"


def _kernel(d: str, kind: str) -> str:
    a = f"abs({d})"
    return f"greatest(0, 1 - {a})" if kind == "bilinear" else f"CASE WHEN {a} < 1 THEN 1.5 * {a} ** 3 - 2.5 * {a} ** 2 + 1 WHEN {a} < 2 THEN -0.5 * {a} ** 3 + 2.5 * {a} ** 2 - 4 * {a} + 2 ELSE 0 END"


def _resample(kind: str) -> None:
    def run(spark, sf_dir):
        return raster.resample(b.px(spark, sf_dir).withColumn("b02", F.when(F.col("b02") > -0.3, F.col("b02"))), ["scene"], 4, 4, 3, "b02", kind)

    run.__name__ = f"{kind}_resample"
    w = f"({_kernel('y - row', kind)}) * ({_kernel('x - col', kind)})"
    query(sql([b.PX, _FINE, f"w AS (SELECT scene, r, c, b02, {w} AS w FROM px, fine WHERE b02 > -0.3 AND abs(y - row) < 2 AND abs(x - col) < 2)"],
              "SELECT scene, CAST(r AS INT) AS row, CAST(c AS INT) AS col, " + r6("CASE WHEN sum(w) <> 0 THEN sum(w * b02) / sum(w) END AS b02") + " FROM w WHERE w <> 0 GROUP BY scene, r, c"))(run)


_resample("bilinear")
_resample("cubic")


_DISTANCE = "cells AS (SELECT scene, row, col, b02 > -0.15 AS clear FROM px), dist AS (SELECT a.scene, a.row, a.col, min(sqrt((a.row - q.row) ** 2 + (a.col - q.col) ** 2)) AS distance FROM cells a LEFT JOIN cells q ON q.scene = a.scene AND NOT q.clear GROUP BY ALL)"


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cloud_distance(b.px(spark, sf_dir).withColumn("clear", F.col("b02") > -0.15), ["scene"], "clear")


@query(sql([b.PX, _DISTANCE], "SELECT scene, row, col, " + r6("distance") + " FROM dist"))
def cloud_distance(spark, sf_dir):
    return _distances(spark, sf_dir)


@query(sql([b.PX, _DISTANCE, "top AS (SELECT *, max(distance) OVER (PARTITION BY scene) AS mx FROM dist)"], "SELECT scene, row, col, " + r6("CASE WHEN mx <= 1 AND distance > 0 THEN 2.0 ELSE distance END AS distance") + " FROM top"))
def distance_rescale(spark, sf_dir):
    return raster.rescale_distance(_distances(spark, sf_dir), ["scene"])


@query(sql([b.PX, "m AS (SELECT *, min(b02) FILTER (b02 > 0) OVER (PARTITION BY scene) AS low, max(b02) FILTER (b02 > 0) OVER (PARTITION BY scene) AS high FROM px)"],
       "SELECT scene, row, col, " + r6("CASE WHEN high > low THEN greatest(0, least(255, (b02 - low) / (high - low) * 255)) END AS stretched") + ", CAST(CASE WHEN b02 = 0 AND b03 = 0 AND b04 = 0 THEN 0 ELSE 255 END AS INT) AS alpha FROM m"))
def stretch_0_255(spark, sf_dir):
    rows = raster.stretch_range(b.px(spark, sf_dir), ["scene"], "b02")
    stretched = F.when(F.col("high") > F.col("low"), indices.stretch(F.col("b02"), F.col("low"), F.col("high")))
    return rows.select("scene", "row", "col", stretched.alias("stretched"), indices.alpha(F.col("b04"), F.col("b03"), F.col("b02")).alias("alpha"))


# -- fusion, gaps and seasons

_HIGH = "high AS (SELECT site, row, col, date, b8a AS value, abs(b02) * 40 AS distance FROM one WHERE dayofyear(date) % 3 = 0), low AS (SELECT site, row, col, date, (b8a + b04) / 2 AS value FROM one)"
_ONE = "one AS (SELECT site, row, col, date, avg(b02) AS b02, avg(b04) AS b04, avg(b8a) AS b8a FROM bright GROUP BY ALL)"


_FUSION = sql([b.PX, b.BRIGHT, _ONE, _HIGH, "target AS (SELECT DISTINCT site, date, sigma FROM one, (VALUES (20), (30)) s(sigma))",
              "res AS (SELECT h.site, h.row, h.col, h.date AS taken, h.value - l.value AS r, h.distance FROM high h JOIN low l USING (site, row, col, date))",
              "w AS (SELECT t.site, t.date, t.sigma, r.row, r.col, r.r, greatest(0, least(1, (r.distance - 1) / 15)) * exp(-CAST((r.taken - t.date) ** 2 AS DOUBLE) / (2.0 * sigma * sigma)) AS w FROM target t JOIN res r ON r.site = t.site AND abs(r.taken - t.date) <= 30)",
              "f AS (SELECT site, date, sigma, row, col, count(*) AS n_acquisitions, CASE WHEN sum(w) <> 0 THEN sum(w * r) / sum(w) END AS m FROM w GROUP BY ALL)"],
             "SELECT f.site, f.row, f.col, f.date, CAST(sigma AS INT) AS sigma, n_acquisitions, " + r6("l.value + m AS fused") + " FROM f LEFT JOIN low l ON l.site = f.site AND l.row = f.row AND l.col = f.col AND l.date = f.date")


@query(_FUSION)
def weighted_fusion(spark, sf_dir):
    one = b.bright(b.px(spark, sf_dir)).groupBy("site", "row", "col", "date").agg(F.avg("b02").alias("b02"), F.avg("b04").alias("b04"), F.avg("b8a").alias("b8a"))
    cell = ["site", "row", "col", "date"]
    high = one.filter(F.dayofyear("date") % 3 == 0).select(*cell, F.col("b8a").alias("value"), (F.abs("b02") * 40).alias("distance"))
    low = one.select(*cell, ((F.col("b8a") + F.col("b04")) / 2).alias("value"))
    targets = one.select("site", "date").distinct().withColumn("sigma", F.explode(F.array(F.lit(20), F.lit(30))))
    return fusion.fuse(high, low, targets, ["site"])


# bright() shifts b02 by 0.6; the distance above is of the shifted band in both engines


_SPATIAL = "trio AS (SELECT scene, row, col, b03 AS truth, b04 AS gap, b8a AS nogap FROM bright WHERE least(b02, b03) > 0.4)"


def _scores_sql(pred: str) -> str:
    return f"""CASE WHEN count(*) >= 2 THEN sqrt(avg((truth - {pred}) ** 2)) END AS rmse, CASE WHEN count(*) >= 2 THEN avg(abs(truth - {pred})) END AS mae, CASE WHEN count(*) >= 2 THEN avg({pred} - truth) END AS mean_bias,
  CASE WHEN count(*) >= 2 AND stddev_pop({pred}) * stddev_pop(truth) > 0 THEN covar_pop({pred}, truth) / (stddev_pop({pred}) * stddev_pop(truth)) END AS pearson_r, CASE WHEN count(*) >= 2 AND var_pop(truth) > 0 THEN 1 - sum((truth - {pred}) ** 2) / (var_pop(truth) * count(*)) END AS nse"""


def _trio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.bright(b.px(spark, sf_dir)).filter(F.least("b02", "b03") > 0.4)
    return rows.select("scene", "row", "col", F.col("b03").alias("truth"), F.col("b04").alias("gap"), F.col("b8a").alias("nogap"))


@query(sql([b.PX, b.BRIGHT, _SPATIAL, f"s AS (SELECT scene, count(*) AS n_pixels, {_scores_sql('gap')} FROM trio GROUP BY scene)"], f"SELECT scene, n_pixels, {r6('rmse', 'mae', 'mean_bias', 'pearson_r', 'nse')} FROM s"))
def spatial_scores(spark, sf_dir):
    return metrics.spatial_scores(_trio(spark, sf_dir), ["scene"], "gap")


@query(sql([b.PX, b.BRIGHT, _SPATIAL, "flat AS (SELECT *, avg(nogap) OVER (PARTITION BY scene) AS constant FROM trio)", f"g AS (SELECT scene, count(*) AS n_pixels, {_scores_sql('gap')} FROM flat GROUP BY scene)",
            f"n AS (SELECT scene, {_scores_sql('nogap')} FROM flat GROUP BY scene)", f"k AS (SELECT scene, {_scores_sql('constant')} FROM flat GROUP BY scene)"],
       "SELECT g.scene, g.n_pixels, " + r6("g.rmse - n.rmse AS delta_rmse", "n.nse - g.nse AS delta_nse", "k.rmse AS rmse_constant") + " FROM g JOIN n USING (scene) JOIN k USING (scene)"))
def gap_evaluation(spark, sf_dir):
    return gap.evaluate(_trio(spark, sf_dir), ["scene"]).select("scene", "n_pixels", "delta_rmse", "delta_nse", "rmse_constant")


_SITES = """sites AS (SELECT s_suppkey AS site, 1998 AS season, CASE WHEN s_suppkey % 3 = 0 THEN make_date(1998, 4, 1 + CAST(s_suppkey % 28 AS INT)) WHEN s_suppkey % 3 = 1 THEN DATE '1997-12-01' END AS green_up,
  CASE WHEN s_suppkey % 2 = 0 THEN DATE '1998-10-05' END AS green_down FROM supplier)"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    up = F.when(key % 3 == 0, F.make_date(F.lit(1998), F.lit(4), (1 + key % 28).cast("int"))).when(key % 3 == 1, F.lit("1997-12-01").cast("date"))
    return b.table(spark, sf_dir, "supplier").select(key.alias("site"), F.lit(1998).alias("season"), up.alias("green_up"), F.when(key % 2 == 0, F.lit("1998-10-05").cast("date")).alias("green_down"))


_MANIFEST = """mids AS (SELECT site, season, CASE WHEN year(green_up) = season THEN 'green_up' WHEN year(green_down) = season THEN 'green_down' ELSE 'mid_season' END AS midpoint_rule,
  coalesce(CASE WHEN year(green_up) = season THEN green_up END, CASE WHEN year(green_down) = season THEN green_down END, make_date(season, 7, 1)) AS mid FROM sites),
near AS (SELECT m.site, a.date, a.filename, row_number() OVER (PARTITION BY m.site ORDER BY abs(a.date - m.mid), a.date, a.filename) AS k FROM mids m JOIN (SELECT DISTINCT site, date, filename FROM acq) a ON a.site = m.site AND abs(a.date - m.mid) <= 365),
wins AS (SELECT m.*, g.gap_days, CAST(mid - g.gap_days // 2 AS DATE) AS s, CAST(mid + (g.gap_days - 1 - g.gap_days // 2) AS DATE) AS e FROM mids m, (VALUES (15), (30), (60), (90)) g(gap_days))"""


@query(sql([b.ACQ, _SITES, _MANIFEST], """SELECT w.site, CAST(w.season AS INT) AS season, CAST(gap_days AS INT) AS gap_days, midpoint_rule, mid AS midpoint_date, mid AS prediction_date, s AS window_start, e AS window_end, n.date AS withheld_date, n.filename AS withheld_filename
FROM wins w LEFT JOIN near n ON n.site = w.site AND n.k = 1"""))
def gap_manifest(spark, sf_dir):
    return gap.manifest(_sites(spark, sf_dir), b.acq(spark, sf_dir).select("site", "date", "filename").distinct()).select("site", "season", "gap_days", "midpoint_rule", "midpoint_date", "prediction_date", "window_start", "window_end", "withheld_date", "withheld_filename")


@query(sql([b.ACQ, _SITES, _MANIFEST], """SELECT w.site, CAST(gap_days AS INT) AS gap_days, count(*) AS n_left FROM wins w LEFT JOIN near n ON n.site = w.site AND n.k = 1 JOIN acq a ON a.site = w.site
WHERE NOT coalesce(a.date = n.date, false) GROUP BY 1, 2"""))
def masked_input(spark, sf_dir):
    entries = gap.manifest(_sites(spark, sf_dir), b.acq(spark, sf_dir).select("site", "date", "filename").distinct())
    return gap.masked(b.acq(spark, sf_dir), entries).groupBy("site", "gap_days").agg(F.count("*").alias("n_left"))


@query(sql([b.ACQ, _SITES, _MANIFEST, "scored AS (SELECT site, count(*) AS n_pixels FROM acq WHERE site % 4 = 0 GROUP BY site)"],
       "SELECT w.site, CAST(gap_days AS INT) AS gap_days, coalesce(n_pixels, 0) AS n_pixels, CASE WHEN n.date IS NULL THEN 'no acquisition to withhold' WHEN n_pixels IS NULL THEN 'no common pixels' END AS error FROM wins w LEFT JOIN near n ON n.site = w.site AND n.k = 1 LEFT JOIN scored p ON p.site = w.site"))
def gap_results(spark, sf_dir):
    acquisitions = b.acq(spark, sf_dir)
    entries = gap.manifest(_sites(spark, sf_dir), acquisitions.select("site", "date", "filename").distinct())
    scores = acquisitions.filter("site % 4 = 0").groupBy("site").agg(F.count("*").alias("n_pixels"))
    return gap.results(entries, scores, ["site"]).select("site", "gap_days", F.coalesce("n_pixels", F.lit(0)).alias("n_pixels"), "error")


_SEASON = """prof AS (SELECT scenario, month(date) * 31 + day(date) AS day, avg(value) AS value FROM ser_long WHERE year(date) = 1998 GROUP BY 1, 2),
p5 AS (SELECT *, lag(value, 2) OVER w AS a, lag(value, 1) OVER w AS b, lead(value, 1) OVER w AS c, lead(value, 2) OVER w AS d FROM prof WINDOW w AS (PARTITION BY scenario ORDER BY day)),
fit AS (SELECT scenario, day, (-3 * coalesce(a, 0) + 12 * coalesce(b, 0) + 17 * value + 12 * coalesce(c, 0) - 3 * coalesce(d, 0)) / (17 + CASE WHEN a IS NULL THEN 0 ELSE -3 END + CASE WHEN b IS NULL THEN 0 ELSE 12 END + CASE WHEN c IS NULL THEN 0 ELSE 12 END + CASE WHEN d IS NULL THEN 0 ELSE -3 END) AS f FROM p5),
pk AS (SELECT scenario, max(f) AS peak, arg_min(day, row(-f, day)) AS peak_day FROM fit GROUP BY scenario),
lv AS (SELECT f.scenario, peak, peak_day, (min(f.f) FILTER (f.day <= peak_day) + min(f.f) FILTER (f.day >= peak_day)) / 2 AS base FROM fit f JOIN pk USING (scenario) GROUP BY ALL),
st AS (SELECT f.scenario, day, f.f, lag(f.f) OVER w AS f0, lag(day) OVER w AS d0, peak, peak_day, base, base + 0.5 * (peak - base) AS t FROM fit f JOIN lv USING (scenario) WINDOW w AS (PARTITION BY f.scenario ORDER BY day))"""


@query(sql([b.SER_LONG, _SEASON], "SELECT scenario, " + r6("base", "peak") + ", CAST(peak_day AS INT) AS peak_day, " + r6("t AS threshold", "min(d0 + (t - f0) / (f - f0) * (day - d0)) FILTER (f0 < t AND f >= t AND day <= peak_day) AS start", 'max(d0 + (t - f0) / (f - f0) * (day - d0)) FILTER (f0 >= t AND f < t AND d0 >= peak_day) AS "end"') + " FROM st GROUP BY scenario, base, peak, peak_day, t"))
def season_thresholds(spark, sf_dir):
    rows = b.ser_long(spark, sf_dir).filter("year(date) = 1998")
    profile = rows.groupBy("scenario", (F.month("date") * 31 + F.dayofmonth("date")).alias("day")).agg(F.avg("value").alias("value"))
    return phenology.season(profile, ["scenario"])


# -- sources and sinks on table columns


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT 'site' || s_suppkey AS site, round(s_acctbal / 100, 6) + 0.0 AS lat, CAST(s_nationkey AS DOUBLE) AS lon, CAST(y AS INT) AS season FROM supplier, (VALUES (2020), (2024)) t(y) WHERE s_suppkey % 2 = 0 OR y = 2024")
def sites_explode(spark, sf_dir):
    key = F.col("s_suppkey")
    seasons = F.when(key % 2 == 0, F.create_map(F.lit("2020"), F.lit(""), F.lit("2024"), F.lit(""), F.lit("all"), F.lit(""))).otherwise(F.create_map(F.lit("2024"), F.lit("")))
    props = F.struct(F.concat(F.lit("site"), key.cast("string")).alias("sitename"), *[F.lit("").alias(c) for c in ("description", "country")], F.lit(0).alias("elevation"), F.lit("").alias("vegetation_type"), F.lit(True).alias("ndvi_selected"), seasons.alias("seasons"))
    at = F.struct(F.array(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 100).alias("coordinates"))
    features = b.table(spark, sf_dir, "supplier").select(F.struct(at.alias("geometry"), props.alias("properties")).alias("f"))
    return readers.site_seasons(features).select("site", "lat", "lon", "season")


@query("WITH i AS (SELECT l_orderkey AS position, CAST(l_shipdate AS DATE) AS date, CAST(l_linenumber % 3 AS VARCHAR) AS increment, 'S2_T_X_' || l_linenumber % 3 || '_' || l_orderkey || '_' || l_linenumber AS item_id, l_linenumber FROM lineitem) SELECT date, increment, arg_min(item_id, row(position, item_id)) AS item_id FROM i GROUP BY 1, 2")
def catalogue_first_items(spark, sf_dir):
    line = F.col("l_linenumber").cast("string")
    item = F.concat_ws("_", F.lit("S2"), F.lit("T"), F.lit("X"), (F.col("l_linenumber") % 3).cast("string"), F.col("l_orderkey").cast("string"), line)
    return readers.catalogue_items(b.table(spark, sf_dir, "lineitem").select(F.struct(F.col("l_orderkey"), item).alias("position"), item.alias("item_id"), F.col("l_shipdate").alias("datetime")))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 1 THEN NULL ELSE value END AS greenness_index FROM events""")
def ground_truth_values(spark, sf_dir):
    key = F.col("event_id")
    primary = F.when(key % 5 == 1, "-9999").when(key % 3 == 0, "").otherwise(F.col("value").cast("string"))
    return b.table(spark, sf_dir, "events").select("event_id", indices.truth_value(primary, F.col("value").cast("string"), F.when(key % 7 == 0, "1.0").otherwise("0")).alias("greenness_index"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN abs(s_acctbal) END AS angle FROM supplier")
def viewing_angles(spark, sf_dir):
    angle = F.concat(F.lit("<Mean_Viewing_Incidence_Angle><ZENITH_ANGLE>"), F.col("s_acctbal").cast("string"), F.lit("</ZENITH_ANGLE></Mean_Viewing_Incidence_Angle>"))
    xml = F.concat(F.lit("<m>"), F.when(F.col("s_suppkey") % 4 > 0, F.concat(angle, F.lit("<Mean_Viewing_Incidence_Angle><ZENITH_ANGLE>7</ZENITH_ANGLE></Mean_Viewing_Incidence_Angle>"))).otherwise(""), F.lit("</m>"))
    return b.table(spark, sf_dir, "supplier").select("s_suppkey", readers.viewing_angle(xml).alias("angle"))


@query(sql([b.SER], "SELECT scenario, '[' || string_agg('{\"date\":\"' || strftime(date, '%Y-%m-%d') || '\",\"n\":' || pos || '}', ',' ORDER BY date) || ']' AS document FROM ser GROUP BY scenario"))
def json_documents(spark, sf_dir):
    rows = b.ser(spark, sf_dir).withColumn("n", F.col("pos"))
    return writers.document(rows, ["scenario"], ["date"], ["date", "n"], "document")


@query("SELECT s_suppkey, " + r6("s_nationkey - 0.0055::DOUBLE AS west", "s_acctbal / 1000 - 0.0055 AS south", "s_nationkey + 0.0055::DOUBLE AS east", "s_acctbal / 1000 + 0.0055 AS north") + ", CAST(floor((60 - s_acctbal / 1000) / 0.01) AS INT) AS row, CAST(floor((s_nationkey + 10) / 0.5) AS INT) AS col FROM supplier")
def bbox_and_pixel(spark, sf_dir):
    lon, lat = F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 1000
    row, col = raster.pixel_of(lon, lat, F.lit(-10.0), F.lit(60.0), F.lit(0.5), F.lit(0.01))
    return b.table(spark, sf_dir, "supplier").select("s_suppkey", *[c.alias(n) for c, n in zip(raster.bbox(lon, lat, 0.011), ("west", "south", "east", "north"), strict=True)], row.alias("row"), col.alias("col"))


from . import files as _files  # noqa: E402, F401
from . import grids as _grids  # noqa: E402, F401  (these register their queries beside the ones above)
from . import products as _products  # noqa: E402, F401
from . import stages as _stages  # noqa: E402, F401
from . import runs as _runs  # noqa: E402, F401  isort: skip
