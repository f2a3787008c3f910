"""Queries through files: what the sinks write of the driver's tables, the readers read again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import gap, raster, series
from ..session import shared_folder
from ..sinks import writers
from ..sources import readers
from . import bindings as b
from .catalogue import _MANIFEST, _SITES, DAYS_OF, _sites, query, r6, sql

DAYS_OF |= {
    "manifest_file": ("midpoint_date", "prediction_date", "window_start", "window_end", "withheld_date"),
    **dict.fromkeys(("ground_truth_file", "cached_three_years", "scene_dates"), ("date",)),
}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(sql([b.SER_LONG], "SELECT scenario, strftime(date, '%Y-%m-%d') AS date, " + r6("value AS greenness_index") + " FROM ser_long"))
def series_file(spark, sf_dir):
    """Daily series as one JSON list per scenario, written and read."""
    path = _folder(spark, "series")
    rows = b.ser_long(spark, sf_dir).select("scenario", F.col("date").cast("string").alias("date"), F.col("value").alias("greenness_index"))
    writers.document(rows, ["scenario"], ["date"], ["date", "greenness_index"], "document").write.partitionBy("scenario").text(path)
    return readers.series(spark, path).select("scenario", "date", "greenness_index")


@query(sql([b.SER, "a AS (SELECT date, value FROM ser WHERE scenario = 'view' AND day(date) % 3 <> 0)", "g AS (SELECT date, value FROM ser WHERE scenario = 'click' AND day(date) % 3 <> 1)"],
           "SELECT strftime(date, '%Y-%m-%d') AS date, CASE WHEN g.date IS NOT NULL THEN 'g \"' || day(date) || '\", b' ELSE 'a \"' || day(date) || '\", b' END AS filename, " + r6("a.value AS ndvi", "g.value AS greenness_index") + " FROM a FULL JOIN g USING (date)"))
def export_file(spark, sf_dir):
    """The export table as CSV with its fixed columns; names hold quotes and commas."""
    rows, day = b.ser(spark, sf_dir), F.dayofmonth("date")
    part = lambda s, k, x, name: rows.filter((F.col("scenario") == s) & (day % 3 != k)).select("date", F.concat(F.lit(f'{x} "'), day.cast("string"), F.lit('", b')).alias("filename"), F.col("value").alias(name))
    none = rows.limit(0).select("date", F.lit("").alias("filename"), *[F.col("value").alias(x) for x in raster.BANDS])
    path = _folder(spark, "export")
    writers.records_csv(series.export_merge(part("view", 0, "a", "ndvi"), part("click", 1, "g", "greenness_index"), none), path)
    back = spark.read.schema(readers.SERIES).option("header", True).option("escape", '"').csv(path)
    return back.select("date", "filename", "ndvi", "greenness_index")


@query(sql([b.ACQ, _SITES, _MANIFEST], """SELECT CAST(w.site AS VARCHAR) AS site, CAST(w.season AS INT) AS season, CAST(gap_days AS INT) AS gap_days, midpoint_rule, mid AS midpoint_date, mid AS prediction_date, s AS window_start, e AS window_end, n.date AS withheld_date, n.filename AS withheld_filename
FROM wins w LEFT JOIN near n ON n.site = w.site AND n.k = 1"""))
def manifest_file(spark, sf_dir):
    """Gap manifests as documents, one per site and season."""
    path = _folder(spark, "manifest")
    entries = gap.manifest(_sites(spark, sf_dir), b.acq(spark, sf_dir).select("site", "date", "filename").distinct())
    writers.manifest(entries.withColumn("site", F.col("site").cast("string")), path)
    back = readers.manifest(spark, path)
    return back.select("site", "season", "gap_days", "midpoint_rule", "midpoint_date", "prediction_date", "window_start", "window_end", "withheld_date", "withheld_filename")


@query("SELECT vec_id % 8 AS site, CAST(2024 AS INT) AS season, vec_id AS scene, " + r6("CAST(embedding[1] AS DOUBLE) AS first", "CAST(embedding[64] AS DOUBLE) AS final") + ", 'v' || vec_id AS angle FROM embeddings")
def tiles_file(spark, sf_dir):
    """Raster tiles with tags, by site and season."""
    path = _folder(spark, "tiles")
    rows = b.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("site"), F.lit(2024).alias("season"), F.col("vec_id").alias("scene"), F.col("embedding").alias("bands"), F.create_map(F.lit("angle"), F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("tags"))
    writers.tiles(rows, path)
    back = spark.read.parquet(path)
    return back.select(F.col("site").cast("long").alias("site"), "season", "scene", F.get("bands", F.lit(0)).cast("double").alias("first"), F.get("bands", F.lit(63)).cast("double").alias("final"), F.col("tags")["angle"].alias("angle"))


@query("SELECT CAST(ts AS DATE) AS date, " + r6("CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS greenness_index") + " FROM events WHERE event_id % 7 <> 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-20' AND value IS NOT NULL")
def ground_truth_file(spark, sf_dir):
    """A camera's summary file, of which flagged rows and days outside the bounds are left out and blanks fall back to the mean."""
    path, key = _folder(spark, "truth"), F.col("event_id")
    ninety = F.when(key % 3 == 0, "").otherwise(F.col("value").cast("string"))
    rows = b.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("date"), F.year("ts").alias("year"), F.dayofyear("ts").alias("doy"), F.when(key % 3 == 0, (F.col("value") + 1).cast("string")).otherwise("NA").alias("gcc_mean"), ninety.alias("gcc_90"), F.when(key % 7 == 0, "1").otherwise("NA").alias("outlierflag_gcc_90"))
    rows.write.option("header", True).csv(path)
    return readers.ground_truth(spark, path, "2024-01-04", "2024-01-20")


@query(sql([b.SER_LONG], "SELECT scenario, date, " + r6("value") + " FROM ser_long WHERE year(date) BETWEEN 1997 AND 1999"))
def cached_three_years(spark, sf_dir):
    """Three years of truth through a cached table: made at the first call, read at the second."""
    path = _folder(spark, "cache")
    make = lambda: readers.three_years(b.ser_long(spark, sf_dir).select("scenario", "date", "value"), F.lit(1998))
    readers.cached_or(spark, path, make)
    return readers.cached_or(spark, path, lambda: make().limit(0))


@query(sql([b.ACQ, "named AS (SELECT DISTINCT date, filename FROM acq)"], "SELECT date, filename, row_number() OVER (ORDER BY date, filename) - 1 AS position FROM named"))
def scene_dates(spark, sf_dir):
    """Prepared scenes listed by day."""
    return readers.scene_dates(b.acq(spark, sf_dir).select("filename"))


@query("SELECT vec_id AS scene, " + r6("CAST(embedding[1] AS DOUBLE) AS first", "CAST(embedding[18] AS DOUBLE) AS middle", "CAST(embedding[64] AS DOUBLE) AS final") + ", CAST(64 AS INT) AS n FROM embeddings")
def stacked_tiles(spark, sf_dir):
    """Pixels stacked to tiles again: bands one after another, row by row."""
    tiles = raster.stack(b.px(spark, sf_dir), ["scene"])
    at = lambda k: F.get("bands", F.lit(k))
    return tiles.select("scene", at(0).alias("first"), at(17).alias("middle"), at(63).alias("final"), F.size("bands").alias("n"))
