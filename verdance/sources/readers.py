"""Readers with declared schemas. Missing inputs give empty tables, NaN becomes null on the way in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import filename_date, increment
from ..functions.indices import truth_value
from ..operators.series import numbered

SERIES = "date string, filename string, ndvi double, greenness_index double, b02 double, b03 double, b04 double, b8a double"
SITES = (
    "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<sitename:string,description:string,country:string,elevation:int,vegetation_type:string,ndvi_selected:boolean,seasons:map<string,struct<note:string>>>>>"
)
ENTRY = "struct<gap_days:int,midpoint_rule:string,midpoint_date:date,window_start:date,window_end:date,prediction_date:date,withheld_date:date,withheld_filename:string>"
SUMMARY = "date string, year int, doy int, gcc_mean string, gcc_90 string, outlierflag_gcc_90 string"


def series(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of day records; no rows if the path does not exist. pos is the order within the file."""
    try:
        rows = spark.read.schema(SERIES).option("multiLine", True).json(path)
        rows.schema  # noqa: B018
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], SERIES)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def sites(spark: SparkSession, path: str) -> DataFrame:
    """One row per site and four-digit season of a feature collection; positions are lon, lat."""
    feature = spark.read.schema(SITES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return site_seasons(feature)


def site_seasons(features: DataFrame) -> DataFrame:
    p = "f.properties."
    each = features.select(F.col(p + "sitename").alias("site"), *[F.col(p + c).alias(c) for c in ("description", "country", "elevation", "vegetation_type", "ndvi_selected")], F.col("f.geometry.coordinates").alias("_at"), F.explode(F.map_keys(F.col(p + "seasons"))).alias("_season"))
    good = each.filter(F.col("_season").rlike(r"^\d{4}$"))
    return good.select(*[c for c in good.columns if c[0] != "_"], F.get("_at", F.lit(1)).alias("lat"), F.get("_at", F.lit(0)).alias("lon"), F.col("_season").cast("int").alias("season"))


def ground_truth(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """(date, greenness_index) of a one-day summary file: comment lines skipped, columns by header, days within the bounds."""
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    have = {c.strip(): c for c in rows.columns}
    col = lambda name: F.col(f"`{have[name]}`") if name in have else F.lit(None).cast("string")
    value = truth_value(col("gcc_90"), col("gcc_mean"), col("outlierflag_gcc_90"))
    out = rows.select(F.trim(col("date")).try_cast("date").alias("date"), value.alias("greenness_index"))
    return out.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("greenness_index").isNotNull())


def scenes(files: DataFrame, name: str = "path") -> DataFrame:
    """File names as dated scenes; distance rasters and undated names go, the first name of a day stays."""
    stem = F.element_at(F.split(name, "/"), -1)
    dated = files.select(name, stem.alias("filename")).filter(~F.col("filename").contains("DIST_CLOUD")).withColumn("date", filename_date(F.col("filename"))).filter("date is not null")
    return dated.groupBy("date").agg(F.min_by(F.struct(name, "filename"), "filename").alias("_s")).select("date", "_s.*")


def catalogue_items(items: DataFrame) -> DataFrame:
    """Scene catalogue rows (position, item_id, datetime): the first of each day and increment in catalogue order."""
    rows = items.withColumn("date", F.col("datetime").cast("date")).withColumn("increment", increment(F.col("item_id")))
    return rows.groupBy("date", "increment").agg(F.min_by("item_id", "position").alias("item_id"))


def viewing_angle(xml: Column) -> Column:
    """The size of the first mean viewing zenith angle of scene metadata; null where there is none."""
    found = F.xpath(xml, F.lit("//Mean_Viewing_Incidence_Angle/ZENITH_ANGLE/text()"))
    return F.abs(F.get(found, F.lit(0)).try_cast("double"))


def band_names(columns: list[str]) -> list[str]:
    """Spectral bands among a cube's variables, in order."""
    import re

    return sorted(c for c in columns if re.fullmatch(r"B\d+A?", c, re.I))


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """A cube's variables under the names of bands; spectral variables without a name are left out, other columns stay."""
    bands = band_names(rows.columns)
    return rows.select(*[F.col(c) for c in rows.columns if c not in bands], *[F.col(c).alias(names[c]) for c in bands if c in names])


def time_steps(cubes: DataFrame, keys: list[str], times: str, bands: list[str]) -> DataFrame:
    """One row per time step of a cube: its day, the number of the step within the day, its file name and its bands.

    `times` and each band are arrays over the steps, so a cube's steps keep their order without a shuffle.
    """
    day = lambda t: t.cast("date")
    each = cubes.select(*keys, times, F.posexplode(F.arrays_zip(*[F.col(b) for b in [times, *bands]])).alias("step", "_s"))
    here = day(F.col(f"_s.{times}"))
    before = F.size(F.filter(F.slice(F.col(times), F.lit(1), F.col("step")), lambda t: day(t) == here))
    name = F.concat(F.date_format(here, "yyyyMMdd"), F.lit("_"), before.cast("string"), F.lit(".geotiff"))
    return each.select(*keys, "step", here.alias("date"), before.alias("increment"), name.alias("filename"), *[F.col(f"_s.{b}").alias(b) for b in bands])


def whole_scenes(rows: DataFrame, scene: list[str], band: str, wanted: list) -> DataFrame:
    """Rows of the scenes that have all wanted bands; scenes that lack one are passed over."""
    full = rows.filter(F.col(band).isin(wanted)).groupBy(*scene).agg(F.count_distinct(band).alias("_n")).filter(F.col("_n") == len(wanted))
    return rows.join(full.select(*scene), scene, "left_semi")


def scan_bounds(items: DataFrame, keys: list[str], position: str, day: str, first: Column, last: Column, safety: int = 100) -> DataFrame:
    """Where a scan of an ordered listing begins and stops per key: some rows before the first day wanted, and at the first later one.

    `stop` is null where no item is later than `last`; positions begin at 0. Where no item reaches `first` the scan begins at the end.
    """
    at = F.coalesce(F.min(F.when(F.col(day) >= first, F.col(position))), F.max(position))
    return items.groupBy(*keys).agg(F.greatest(F.lit(0), at - safety).alias("start"), F.min(F.when(F.col(day) > last, F.col(position))).alias("stop"))


def listing_window(items: DataFrame, keys: list[str], position: str, day: str, first: Column, last: Column, safety: int = 100) -> DataFrame:
    """Items of a listing with days within bounds, up to the first later one: what follows that in the listing is not read."""
    bounds = scan_bounds(items, keys, position, day, first, last, safety)
    read = (F.col(position) >= F.col("start")) & (F.col("stop").isNull() | (F.col(position) < F.col("stop")))
    return items.join(bounds, keys).filter(read & F.col(day).between(first, last)).drop("start", "stop")


def first_items(items: DataFrame, position: str, most: int = 1000) -> DataFrame:
    """The first items in catalogue order; the bound is the catalogue's own."""
    return items.orderBy(position).limit(most)


def first_region(regions: DataFrame, site: str = "site", position: str = "position", value: str = "summary") -> DataFrame:
    """Per site the summary of its first region in listing order; an empty one counts as none."""
    return regions.groupBy(site).agg(F.min_by(F.struct(F.nullif(value, F.lit("")).alias(value)), position).alias("_r")).select(site, f"_r.{value}").filter(F.col(value).isNotNull())


def three_years(truth: DataFrame, season: Column, day: str = "date") -> DataFrame:
    """One scan for the season's year and the years about it."""
    return truth.filter(F.year(day).between(season - 1, season + 1))


def site_seasons_of_paths(paths: DataFrame, tail: str, name: str = "path") -> DataFrame:
    """Distinct (site, season) of files `<site>/<season>/<tail>`; a season is digits only."""
    form = r"([^/]+)/(\d+)/\Q" + tail + r"\E$"
    found = paths.filter(F.col(name).rlike("(^|/)" + form))
    part = lambda k: F.regexp_extract(name, form, k)
    return found.select(part(1).alias("site"), part(2).cast("int").alias("season")).distinct()


def site_seasons_below(spark: SparkSession, root: str, tail: str) -> DataFrame:
    """site_seasons_of_paths over the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", tail.rsplit("/", 1)[-1]).load(root)
    return site_seasons_of_paths(files.select("path"), tail)


def cached_or(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path if it is there and holds rows, else what `make` gives, written there first."""
    try:
        rows = spark.read.parquet(path)
        if not rows.isEmpty():
            return rows
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of gap manifests, one row each; FileNotFoundError if there is no manifest."""
    try:
        documents = spark.read.schema(f"site string, season int, entries array<{ENTRY}>").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no manifest at {path}") from e
    return documents.select("site", "season", F.explode("entries").alias("_e")).select("site", "season", "_e.*")


def unseen(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """What an incremental run still has to read."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def available(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(present.select(*keys).distinct(), keys, "left_semi")


def site_by_name(rows: DataFrame, sites: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """rows with the site of their name: the first of equally named sites in their listing; rows of unknown names go."""
    first = sites.groupBy(name).agg(F.min_by("site", position).alias("site"))
    return rows.join(first, name)


def scene_dates(files: DataFrame, name: str = "filename") -> DataFrame:
    """Names of prepared reflectance scenes with their days, each once, numbered by day, then name; other files are passed over."""
    day = F.to_date(F.nullif(F.regexp_extract(name, r"(?i)_(\d{8})_REFL\.tif$", 1), F.lit("")), "yyyyMMdd")
    return numbered(files.select(day.alias("date"), name).filter("date is not null").distinct(), ["date", name])
