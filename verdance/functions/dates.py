"""Dates in file names and day keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filename_date(name: Column) -> Column:
    """The first eight-digit token between underscores as a date; null where there is none or it is no date."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    token = F.get(F.filter(F.split(stem, "_"), lambda x: x.rlike(r"^\d{8}$")), F.lit(0))
    return F.try_to_timestamp(token, F.lit("yyyyMMdd")).cast("date")


def filename_day_or_stem(name: Column) -> Column:
    """The ISO day of a name, or its part before the first underscore where it holds none."""
    return F.coalesce(F.date_format(filename_date(name), "yyyy-MM-dd"), F.split(name, "_")[0])


def product_day(name: Column) -> Column:
    """yyyyMMdd before a product suffix, in either case; empty where the name has another form."""
    return F.regexp_extract(name, r"(?i)_(\d{8})_(?:REFL|GCC|DIST_CLOUD)\.tif$", 1)


def increment(item: Column) -> Column:
    """The fourth token of an item id, or 0."""
    return F.coalesce(F.try_element_at(F.split(item, "_"), F.lit(4)), F.lit("0"))


def day_key(text: Column) -> Column:
    """The ISO day of a date or date-time text."""
    return F.substring(F.split(text, "T")[0], 1, 10)


def year_day(day: Column) -> Column:
    """yyyyddd as a whole number."""
    return F.year(day) * 1000 + F.dayofyear(day)


def from_year_day(x: Column) -> Column:
    """yyyyddd, rounded, back to a date; null below 100000 or where not finite."""
    n = F.round(x).cast("long")
    good = x.isNotNull() & ~F.isnan(x.cast("double")) & (x >= 100_000)
    return F.when(good, F.date_add(F.make_date((F.floor(n / 1000)).cast("int"), F.lit(1), F.lit(1)), (n % 1000 - 1).cast("int")))


def days_in_year(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def within_season(day: Column, season: Column) -> Column:
    """The day if it lies in the season's year, else null."""
    return F.when(F.year(day) == season, day)


def centred_window(mid: Column, days: Column, season: Column) -> tuple[Column, Column]:
    """First and last day of a window of `days` days about `mid`, moved into the season's year where it would leave it."""
    y0, y1 = F.make_date(season, F.lit(1), F.lit(1)), F.make_date(season, F.lit(12), F.lit(31))
    half = F.floor(days / 2).cast("int")
    start, end = F.date_sub(mid, half), F.date_add(mid, days - 1 - half)
    early, late = F.greatest(F.datediff(y0, start), F.lit(0)), F.greatest(F.datediff(end, y1), F.lit(0))
    # A window that begins too early moves later; what then or already ends too late moves earlier.
    end_1 = F.when(early > 0, F.least(y1, F.date_add(end, early))).otherwise(end)
    start_1 = F.greatest(start, y0)
    return F.when(late > 0, F.greatest(y0, F.date_sub(start_1, late))).otherwise(start_1), F.least(end_1, y1)


def period(text: Column, year: Column) -> tuple[Column, Column]:
    """First and last day of a `start/end` text; of the whole year where the text is null or has no two days."""
    parts = F.split(text, "/")
    first, last = (F.get(parts, F.lit(k)).try_cast("date") for k in range(2))
    good = first.isNotNull() & last.isNotNull()
    return F.when(good, first).otherwise(F.make_date(year, F.lit(1), F.lit(1))), F.when(good, last).otherwise(F.make_date(year, F.lit(12), F.lit(31)))


def season_of_path(path: Column, default: Column) -> Column:
    """The first part of a path that is four digits, else the default."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda p: p.rlike(r"^\d{4}$")), F.lit(0)).cast("int"), default.cast("int"))


def index_name(name: Column) -> Column:
    """The name of the index raster of a prepared or composite one; other rasters change their suffix only, other files nothing."""
    stem = F.regexp_extract(name, r"^(.*)\.tif$", 1)
    token = F.split(stem, "_")
    fine = (F.size(token) >= 3) & F.startswith(stem, F.lit("S2"))
    day = F.when(fine, F.get(token, F.lit(2))).otherwise(F.coalesce(F.get(token, F.lit(1)), F.get(token, F.lit(0))))
    made = F.when(F.contains(stem, F.lit("REFL")), F.concat(day, F.lit("_ndvi.geotiff"))).otherwise(F.concat(stem, F.lit(".geotiff")))
    return F.when(name.endswith(".tif"), made).otherwise(name)


def withheld_day(entry_day: Column, filename: Column) -> Column:
    """The ISO day of a withheld acquisition: as stated, else of its name."""
    return F.coalesce(F.date_format(entry_day, "yyyy-MM-dd"), F.date_format(filename_date(filename), "yyyy-MM-dd"))
