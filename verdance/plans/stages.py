"""Queries of the reading stages, of fusion by all scenarios, of whole gap experiments and of plotted series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import gap, metrics, products, raster, reports
from ..sinks import writers
from ..sources import listing, readers
from . import bindings as b
from .catalogue import _ONE, _SEASON, DAYS_OF, query, r6, sql

DAYS_OF |= {
    **dict.fromkeys("cube_steps listing_window paged_listing three_years plotted_series scenario_series".split(), ("date",)),
    "within_seasons": ("day",),
    "phenology_all": ("green_up", "green_down"),
    "phenology_three_years": ("peak_day", "green_up", "green_down"),
    "gap_experiment": ("prediction_date", "withheld_date"),
}

# -- reading


@query(sql(["base AS (SELECT vec_id AS scene, CAST(DATE '2024-01-01' + CAST(vec_id % 366 AS INT) AS DATE) AS d, embedding FROM embeddings)", "s(step, away, increment) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 0, 2))"],
           "SELECT scene, CAST(step AS INT) AS step, CAST(d + away AS DATE) AS date, CAST(increment AS INT) AS increment, strftime(d + away, '%Y%m%d') || '_' || increment || '.geotiff' AS filename, " + r6("CAST(embedding[step + 1] AS DOUBLE) AS b02", "CAST(embedding[step + 5] AS DOUBLE) AS b03") + " FROM base, s"))
def cube_steps(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 366).cast("int"))
    band = lambda k: F.transform(F.slice("embedding", k, 4), lambda x: x.cast("double"))
    times = F.array(*[F.date_add(day, k).cast("timestamp") for k in (0, 0, 1, 0)])
    cubes = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene"), times.alias("t"), band(1).alias("B02"), band(5).alias("B03"), band(9).alias("B99"))
    return readers.time_steps(readers.renamed(cubes, {"B02": "b02", "B03": "b03"}), ["scene"], "t", ["b02", "b03"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4 GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 4)")
def whole_scenes(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return readers.whole_scenes(rows, ["l_orderkey"], "l_linenumber", [1, 2, 3, 4])


@query(sql([b.ACQ, "listed AS (SELECT site, pos, date, row_number() OVER (PARTITION BY site ORDER BY year(date) * 100 + month(date), pos) - 1 AS position FROM acq)", "ends AS (SELECT site, min(position) FILTER (date > DATE '1996-06-15') AS stop FROM listed GROUP BY site)"],
           "SELECT site, pos, date, CAST(position AS INT) AS position FROM listed JOIN ends USING (site) WHERE date BETWEEN DATE '1996-01-10' AND DATE '1996-06-15' AND (stop IS NULL OR position < stop)"))
def listing_window(spark, sf_dir):
    """A listing by month whose days within a month are out of order, so that the scan stops before some of the last ones."""
    w = Window.partitionBy("site").orderBy(F.year("date") * 100 + F.month("date"), "pos")
    listed = b.acq(spark, sf_dir).select("site", "pos", "date", (F.row_number().over(w) - 1).alias("position"))
    return readers.listing_window(listed, ["site"], "position", "date", F.lit("1996-01-10").cast("date"), F.lit("1996-06-15").cast("date"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000")
def catalogue_limit(spark, sf_dir):
    return readers.first_items(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("WITH r AS (SELECT c_nationkey AS site, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS summary FROM customer) SELECT site, arg_min(summary, c_custkey) AS summary FROM r GROUP BY site HAVING arg_min(summary, c_custkey) <> ''")
def first_region(spark, sf_dir):
    summary = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return readers.first_region(b.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("position"), summary.alias("summary")))


@query(sql([b.SER_LONG], "SELECT scenario, date, " + r6("value") + " FROM ser_long WHERE year(date) BETWEEN 1997 AND 1999"))
def three_years(spark, sf_dir):
    return readers.three_years(b.ser_long(spark, sf_dir).select("scenario", "date", "value"), F.lit(1998))


@query("SELECT DISTINCT 'site' || s_nationkey AS site, CAST(2000 + s_suppkey % 5 AS INT) AS season FROM supplier WHERE s_suppkey % 4 > 1")
def discovered_site_seasons(spark, sf_dir):
    key = F.col("s_suppkey")
    season = F.when(key % 4 == 0, F.lit("x")).otherwise((2000 + key % 5).cast("string"))
    tail = F.when(key % 4 == 1, F.lit("raw/other.json")).otherwise(F.lit("raw/truth/series.json"))
    paths = b.table(spark, sf_dir, "supplier").select(F.concat_ws("/", F.lit("data"), F.concat(F.lit("site"), F.col("s_nationkey").cast("string")), season, tail).alias("path"))
    return readers.site_seasons_of_paths(paths, "raw/truth/series.json")


@query("SELECT s_suppkey, " + r6("(20 - least(s_nationkey + 1.5::DOUBLE, 20)) / 0.25 AS row", "(greatest(s_acctbal / 1000 - 1, 0) - 0) / 0.5 AS col", "(least(s_nationkey + 1.5::DOUBLE, 20) - greatest(s_nationkey - 0.5::DOUBLE, 2)) / 0.25 AS height", "(least(s_acctbal / 1000 + 2, 9) - greatest(s_acctbal / 1000 - 1, 0)) / 0.5 AS width") + " FROM supplier")
def bbox_window(spark, sf_dir):
    x, y = F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")
    corners = [(x, y + 1), (x - 1, y), (x + 2, y - 0.5), (x + 1, y + 1.5)]
    found = raster.envelope_window(corners, *[F.lit(v) for v in (0.0, 2.0, 9.0, 20.0, 0.5, 0.25)])
    return b.table(spark, sf_dir, "supplier").select("s_suppkey", *[c.alias(n) for c, n in zip(found, ("row", "col", "height", "width"), strict=True)])


@query("SELECT s_suppkey AS site, 'prepared_' || s.strategy || CASE WHEN o.mode = 'itb' THEN '_itb' ELSE '' END || '/fusion' || CASE WHEN g.sigma <> 20 THEN '_sigma' || g.sigma ELSE '' END AS path FROM supplier, (VALUES ('aggressive'), ('nonaggressive')) s(strategy), (VALUES (20), (30)) g(sigma), (VALUES ('bti'), ('itb')) o(mode)")
def product_paths(spark, sf_dir):
    """The fusion folders of every site."""
    rows = metrics.scenarios_of(b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site")))
    return rows.select("site", writers.product_path(F.lit("fusion"), F.col("strategy"), F.col("mode"), F.col("sigma")).alias("path"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 + o_orderkey % 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def within_seasons(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", dates.within_season(F.col("o_orderdate").cast("date"), 1996 + F.col("o_orderkey") % 3).alias("day"))


# -- series


@query(sql([b.SER_LONG, "r AS (SELECT scenario, min(date) AS d0, max(date) AS d1, min(value) AS low, max(value) AS high, arg_min(date, row(abs(date - DATE '1998-03-15'), date)) AS near FROM ser_long GROUP BY scenario)"],
           "SELECT scenario, date, " + r6("value", "30 + (date - d0) / CAST(d1 - d0 AS DOUBLE) * 540 AS x", "70 - (value - low) / (high - low) * 40 AS y", "low", "high") + ", date = near AS marked FROM ser_long JOIN r USING (scenario)"))
def plotted_series(spark, sf_dir):
    return reports.plotted(b.ser_long(spark, sf_dir), ["scenario"], "value", F.lit("1998-03-15").cast("date"), 600.0, 100.0)


_BY_YEAR = _SEASON.replace("SELECT scenario, month(date) * 31 + day(date) AS day, avg(value) AS value FROM ser_long WHERE year(date) = 1998 GROUP BY 1, 2", "SELECT scenario || '|' || year(date) AS scenario, dayofyear(date) AS day, avg(value) AS value FROM ser_long GROUP BY 1, 2")


@query(sql([b.SER_LONG, _BY_YEAR, "found AS (SELECT scenario, min(d0 + (t - f0) / (f - f0) * (day - d0)) FILTER (f0 < t AND f >= t AND day <= peak_day) AS up, max(d0 + (t - f0) / (f - f0) * (day - d0)) FILTER (f0 >= t AND f < t AND d0 >= peak_day) AS down FROM st GROUP BY scenario)",
            "ss AS (SELECT scenario AS site, CAST(unnest(range(1994, 2003)) AS INT) AS season FROM (SELECT DISTINCT scenario FROM ser_long))"],
           "SELECT site, season, CAST(make_date(season, 1, 1) + CAST(round(up) AS INT) - 1 AS DATE) AS green_up, CAST(make_date(season, 1, 1) + CAST(round(down) AS INT) - 1 AS DATE) AS green_down FROM ss LEFT JOIN found ON found.scenario = site || '|' || season"))
def phenology_all(spark, sf_dir):
    """All site-seasons, also those without ground truth."""
    truth = b.ser_long(spark, sf_dir).select(F.col("scenario").alias("site"), "date", "value")
    wanted = truth.select("site").distinct().withColumn("season", F.explode(F.sequence(F.lit(1994), F.lit(2002))))
    return products.phenology_of_site_seasons(wanted, truth)


_STACK = [
    b.SER_LONG, "obs AS (SELECT scenario, CAST(year(date) AS INT) AS y, CAST(dayofyear(date) AS INT) AS d, value AS v FROM ser_long WHERE value > 0)",
    "near AS (SELECT *, lag(v, 1) OVER w AS a1, lag(v, 2) OVER w AS a2, lead(v, 1) OVER w AS b1, lead(v, 2) OVER w AS b2, stddev_pop(v) OVER (PARTITION BY scenario, y) AS sd, count(*) OVER (PARTITION BY scenario, y) AS many FROM obs WINDOW w AS (PARTITION BY scenario, y ORDER BY d))",
    "seen AS (SELECT scenario, y, d, v FROM near WHERE many <= 2 OR NOT (v > greatest(a1, a2, b1, b2) + 2 * sd OR v < least(a1, a2, b1, b2) - 2 * sd))",
    "grid AS (SELECT scenario, y, CAST(unnest(range(1, CASE WHEN y % 4 = 0 THEN 367 ELSE 366 END)) AS INT) AS d FROM (SELECT DISTINCT scenario, y FROM obs))",
    """spread AS (SELECT g.scenario, g.y, g.d, s.v, last_value(CASE WHEN s.v IS NOT NULL THEN g.d END IGNORE NULLS) OVER b AS d0, last_value(s.v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN s.v IS NOT NULL THEN g.d END IGNORE NULLS) OVER a AS d1, first_value(s.v IGNORE NULLS) OVER a AS v1
  FROM grid g LEFT JOIN seen s ON s.scenario = g.scenario AND s.y = g.y AND s.d = g.d WINDOW b AS (PARTITION BY g.scenario, g.y ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY g.scenario, g.y ORDER BY g.d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "daily AS (SELECT scenario, y, d, coalesce(v, v0 + (v1 - v0) / (d1 - d0) * (d - d0), v0, v1) AS v FROM spread WHERE d <= 365)",
    "having3 AS (SELECT a.scenario, a.y AS season, count(*) = 3 AS whole FROM (SELECT DISTINCT scenario, y FROM obs) a JOIN (SELECT DISTINCT scenario, y FROM obs) o ON o.scenario = a.scenario AND abs(o.y - a.y) <= 1 GROUP BY 1, 2)",
    "stacked AS (SELECT h.scenario, h.season, h.whole, part * 365 + d.d - 1 AS p, d.v FROM having3 h, (VALUES (0), (1), (2)) parts(part), daily d WHERE d.scenario = h.scenario AND d.y = CASE WHEN h.whole THEN h.season - 1 + part ELSE h.season END)",
    "p5 AS (SELECT *, lag(v, 2) OVER w AS a, lag(v, 1) OVER w AS b, lead(v, 1) OVER w AS c, lead(v, 2) OVER w AS e FROM stacked WINDOW w AS (PARTITION BY scenario, season ORDER BY p))",
    "fit AS (SELECT scenario, season, whole, p, (-3 * coalesce(a, 0) + 12 * coalesce(b, 0) + 17 * v + 12 * coalesce(c, 0) - 3 * coalesce(e, 0)) / (17 + CASE WHEN a IS NULL THEN 0 ELSE -3 END + CASE WHEN b IS NULL THEN 0 ELSE 12 END + CASE WHEN c IS NULL THEN 0 ELSE 12 END + CASE WHEN e IS NULL THEN 0 ELSE -3 END) AS f FROM p5)",
    "pk AS (SELECT scenario, season, max(f) AS fitted_max, max(f) FILTER (p BETWEEN 365 AND 729) AS peak, arg_min(p, row(-f, p)) FILTER (p < 365) AS before, arg_min(p, row(-f, p)) FILTER (p BETWEEN 365 AND 729) AS mid, arg_min(p, row(-f, p)) FILTER (p > 729) AS after FROM fit GROUP BY 1, 2)",
    "lv AS (SELECT f.scenario, f.season, min(f.f) FILTER (p BETWEEN before AND mid) AS l, arg_min(p, row(f.f, -p)) FILTER (p BETWEEN before AND mid) AS lp, min(f.f) FILTER (p BETWEEN mid AND after) AS r, arg_min(p, row(f.f, p)) FILTER (p BETWEEN mid AND after) AS rp FROM fit f JOIN pk USING (scenario, season) GROUP BY 1, 2)",
    "st AS (SELECT f.scenario, f.season, f.whole, p, f.f, lag(f.f) OVER w AS f0, fitted_max, peak, mid, lp, rp, l + 0.5 * (peak - l) AS tl, r + 0.5 * (peak - r) AS tr FROM fit f JOIN pk USING (scenario, season) JOIN lv USING (scenario, season) WINDOW w AS (PARTITION BY f.scenario, f.season ORDER BY p))",
    "hits AS (SELECT scenario, season, whole, fitted_max, peak, mid, tl, tr, min(p - 1 + (tl - f0) / (f - f0)) FILTER (f0 < tl AND f >= tl AND p > lp AND p <= mid) AS up, max(p - 1 + (tr - f0) / (f - f0)) FILTER (f0 >= tr AND f < tr AND p - 1 >= mid AND p <= rp) AS down FROM st GROUP BY ALL)",
]


def _stack_day(x: str) -> str:
    """The date of a place in a stack; its years leave out the last day of leap years."""
    n = f"CAST(floor({x} + 0.5) AS INT)"
    return f"CAST(make_date(season - 1, 1, 1) + {n} + CASE WHEN (season - 1) % 4 = 0 AND {n} >= 365 THEN 1 ELSE 0 END + CASE WHEN season % 4 = 0 AND {n} >= 730 THEN 1 ELSE 0 END AS DATE)"


@query(sql([*_STACK, "ss AS (SELECT scenario, CAST(unnest(range(1994, 2003)) AS INT) AS season FROM (SELECT DISTINCT scenario FROM ser_long))"],
           "SELECT scenario AS site, season, CASE WHEN whole THEN 'three_independent_years' WHEN NOT whole THEN 'single_year_replicated' END AS stack, " + r6("peak") + f", {_stack_day('mid')} AS peak_day, {_stack_day('up')} AS green_up, {_stack_day('down')} AS green_down, " + r6("CASE WHEN up IS NOT NULL THEN tl END AS green_up_value", "CASE WHEN down IS NOT NULL THEN tr END AS green_down_value", "fitted_max") + " FROM ss LEFT JOIN hits USING (scenario, season)"))
def phenology_three_years(spark, sf_dir):
    """All site-seasons, on stacks of three years where there are as many."""
    truth = b.ser_long(spark, sf_dir).select(F.col("scenario").alias("site"), "date", "value")
    wanted = truth.select("site").distinct().withColumn("season", F.explode(F.sequence(F.lit(1994), F.lit(2002))))
    return products.phenology_of_three_years(wanted, truth)


# -- fusion

_ALL = _ONE.replace("avg(b04)", "avg(b03) AS b03, avg(b04)")
_GCC = "CASE WHEN least(b02, b03, b04) >= 0 AND b02 + b03 + b04 > 0 THEN b03 / (b02 + b03 + b04) END"
_RGR = "CASE WHEN b04 + b03 + b04 > 0 THEN nullif(b03 / (b04 + b03 + b04), 0) END"
_LAYERS = (*raster.BANDS, "index")
_LONG = lambda name, more: " UNION ALL ".join(f"SELECT site, row, col, date, strategy, '{x}' AS layer, {_RGR if x == 'index' else x} AS value{more} FROM {name}" for x in _LAYERS)
_SCENARIOS = [
    b.PX, b.BRIGHT, _ALL, "strategies(strategy) AS (VALUES ('aggressive'), ('nonaggressive'))",
    "fine AS (SELECT one.*, abs(b02) * 40 AS distance, strategy FROM one, strategies WHERE dayofyear(date) % 3 = 0 AND dayofyear(date) % CASE WHEN strategy = 'aggressive' THEN 5 ELSE 4 END <> 0)",
    "coarse AS (SELECT site, row, col, date, (b02 + b03) / 2 AS b02, (b03 + b04) / 2 AS b03, (b04 + b8a) / 2 AS b04, (b8a + b02) / 2 AS b8a, strategy FROM one, strategies)",
    "high AS (" + _LONG("fine", ", distance") + ")", "low AS (" + _LONG("coarse", "") + ")",
    "res AS (SELECT site, strategy, layer, row, col, date AS taken, h.value - l.value AS r, distance FROM high h JOIN low l USING (site, strategy, layer, row, col, date))",
    "target AS (SELECT DISTINCT site, date, sigma FROM one, (VALUES (20), (30)) g(sigma))",
    "w AS (SELECT t.site, t.date, sigma, strategy, layer, row, col, r, greatest(0, least(1, (distance - 1) / 15)) * exp(-CAST((taken - t.date) ** 2 AS DOUBLE) / (2.0 * sigma * sigma)) AS w FROM target t JOIN res ON res.site = t.site AND abs(taken - t.date) <= 30)",
    "m AS (SELECT site, date, sigma, strategy, layer, row, col, CASE WHEN sum(w) <> 0 THEN sum(w * r) / sum(w) END AS m FROM w GROUP BY ALL)",
    "f AS (SELECT site, date, sigma, strategy, layer, row, col, l.value + m AS fused FROM m JOIN low l USING (site, strategy, layer, row, col, date))",
    "wide AS (SELECT site, date, row, col, strategy || '_sigma' || sigma || CASE WHEN layer = 'index' THEN '_itb' ELSE '' END AS scenario, " + ", ".join(f"max(fused) FILTER (layer = '{x}') AS {x if x != 'index' else 'itb'}" for x in _LAYERS) + " FROM f GROUP BY 1, 2, 3, 4, 5)",
]
_SOUND = "b04 > 0 AND b8a > 0"


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.bright(b.px(spark, sf_dir)).groupBy("site", "row", "col", "date").agg(*[F.avg(x).alias(x) for x in raster.BANDS])


@query(sql(_SCENARIOS, "SELECT site, scenario, date, " + r6(f"avg(CASE WHEN {_SOUND} THEN (b8a - b04) / (b8a + b04) END) AS ndvi", f"avg(coalesce(itb, {_GCC})) AS greenness_index", *[f"avg(CASE WHEN {_SOUND} THEN {x} END) AS {x}" for x in raster.BANDS]) + " FROM wide WHERE row BETWEEN 0 AND 2 AND col BETWEEN 1 AND 3 GROUP BY 1, 2, 3"))
def scenario_series(spark, sf_dir):
    """All scenarios fused on all days, and their series about the site."""
    one, day = _one(spark, sf_dir), F.dayofyear("date")
    fine = one.filter(day % 3 == 0).select("*", (F.abs("b02") * 40).alias("distance"), (day % 5 == 0).alias("excluded_aggressive"), (day % 4 == 0).alias("excluded_nonaggressive"))
    mean = lambda x, y: ((F.col(x) + F.col(y)) / 2).alias(x)
    coarse = one.select("site", "row", "col", "date", mean("b02", "b03"), mean("b03", "b04"), mean("b04", "b8a"), mean("b8a", "b02"))
    return products.scenario_series(products.fused_scenarios(fine, coarse), F.lit(1), F.lit(2))


_SCORES = ["rmse", "mae", "nse", "rmse_nogap", "nse_nogap", "rmse_constant", "delta_rmse", "delta_nse"]
_GAP = [
    b.PX, b.BRIGHT, _ONE, "high AS (SELECT site, row, col, date, b8a AS value, abs(b02) * 40 AS distance FROM one WHERE dayofyear(date) % 3 = 0)", "low AS (SELECT site, row, col, date, (b8a + b04) / 2 AS value FROM one)",
    "held AS (SELECT site, min(date) FILTER (date >= DATE '2024-04-01') AS day FROM high GROUP BY site HAVING day IS NOT NULL)",
    "res AS (SELECT site, row, col, h.date AS taken, h.value - l.value AS r, h.distance FROM high h JOIN low l USING (site, row, col, date))",
    "w AS (SELECT site, day, run, row, col, r, greatest(0, least(1, (distance - 1) / 15)) * exp(-CAST((taken - day) ** 2 AS DOUBLE) / 800) AS w FROM held JOIN res USING (site), (VALUES ('gap'), ('nogap')) o(run) WHERE abs(taken - day) <= 30 AND (run = 'nogap' OR taken <> day))",
    "m AS (SELECT site, day, run, row, col, CASE WHEN sum(w) <> 0 THEN sum(w * r) / sum(w) END AS m FROM w GROUP BY ALL)",
    "p AS (SELECT m.site, day, m.row, m.col, max(l.value + m) FILTER (run = 'gap') AS gap, max(l.value + m) FILTER (run = 'nogap') AS nogap, any_value(t.value) AS truth FROM m JOIN low l ON l.site = m.site AND l.row = m.row AND l.col = m.col AND l.date = day JOIN high t ON t.site = m.site AND t.row = m.row AND t.col = m.col AND t.date = day GROUP BY ALL)",
    "k AS (SELECT *, avg(nogap) OVER (PARTITION BY site) AS flat FROM p WHERE gap IS NOT NULL AND nogap IS NOT NULL)",
    """s AS (SELECT site, count(*) AS n_pixels, sqrt(avg((truth - gap) ** 2)) AS rmse, avg(abs(truth - gap)) AS mae, 1 - sum((truth - gap) ** 2) / (var_pop(truth) * count(*)) AS nse, sqrt(avg((truth - nogap) ** 2)) AS rmse_nogap,
  1 - sum((truth - nogap) ** 2) / (var_pop(truth) * count(*)) AS nse_nogap, sqrt(avg((truth - flat) ** 2)) AS rmse_constant FROM k GROUP BY site)""",
]


@query(sql(_GAP, "SELECT held.site, CAST(2024 AS INT) AS season, CAST(gap_days AS INT) AS gap_days, day AS prediction_date, day AS withheld_date, n_pixels, " + r6(*_SCORES[:6], "rmse - rmse_nogap AS delta_rmse", "nse_nogap - nse AS delta_nse") + ", CASE WHEN n_pixels IS NULL THEN 'no common pixels' END AS error FROM held LEFT JOIN s USING (site), (VALUES (15), (30), (60), (90)) g(gap_days)"))
def gap_experiment(spark, sf_dir):
    """Manifest, masked fusion, scores and results of all sites in one plan; a site's midpoint is the first fine day from April on."""
    one = _one(spark, sf_dir)
    cell = ["site", "row", "col", "date"]
    high = one.filter(F.dayofyear("date") % 3 == 0).select(*cell, F.col("b8a").alias("value"), (F.abs("b02") * 40).alias("distance"))
    low = one.select(*cell, ((F.col("b8a") + F.col("b04")) / 2).alias("value"))
    taken = high.select("site", "date").distinct().withColumn("filename", F.date_format("date", "yyyyMMdd"))
    sites = taken.filter("date >= date'2024-04-01'").groupBy("site").agg(F.min("date").alias("green_up")).select("site", F.lit(2024).alias("season"), "green_up", F.lit(None).cast("date").alias("green_down"))
    out = products.gap_experiment(gap.manifest(sites, taken), high, low)
    return out.select("site", "season", "gap_days", "prediction_date", "withheld_date", "n_pixels", *_SCORES, "error")


@query("SELECT event_id, event_type, CAST(ts AS DATE) AS date, " + r6("value") + " FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def paged_listing(spark, sf_dir):
    """Events as a listing in the order of time, a hundred to a page."""
    rows = listing.paged_listing(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp_ntz, event_type string, value double", "ts", "2024-01-05", "2024-01-09")
    return rows.select("event_id", "event_type", F.col("ts").cast("date").alias("date"), "value")
