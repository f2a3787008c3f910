"""Screening of acquisitions: cloud by a day-range window, darkness by the blue band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import DARK_BLUE, ndvi, positive
from .raster import pixel_of, to_utm

WINDOW_DAYS, LEAST_NEIGHBOURS = 14, 3
#: strategy: (absolute NDVI threshold, allowed drop below the window's maximum); fixed values.
STRATEGIES = {"aggressive": (0.3, 0.15), "nonaggressive": (0.2, 0.25)}


def dark(blue: Column, limit: Column | float) -> Column:
    """Blue strictly below its limit; a null blue is not dark."""
    return F.coalesce(blue < limit, F.lit(False))


def dark_limit(source: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, limit in DARK_BLUE.items():
        out = F.when(source == name, limit).otherwise(out)
    return out


def flag_exclusions(acquisitions: DataFrame, limit: Column | float, keys: tuple[str, ...] = ("site", "source"), day: str = "day", index: str = "ndvi", blue: str = "b02") -> DataFrame:
    """acquisitions with neighbours, window_max and one excluded_<strategy> flag each, all strategies in one window pass.

    `day` is a whole day number. The window takes every row within 14 days, itself and dark rows included, but no null index.
    A null index or a dark scene is excluded; with fewer than 3 neighbours a row is kept; else it is excluded when the index is
    both below the window's maximum less the allowed drop and below the threshold.
    """
    near = Window.partitionBy(*keys).orderBy(day).rangeBetween(-WINDOW_DAYS, WINDOW_DAYS)
    out = acquisitions.withColumn("neighbours", F.count(index).over(near)).withColumn("window_max", F.max(index).over(near))
    for strategy, (threshold, drop) in STRATEGIES.items():
        low = (F.col(index) < F.col("window_max") - drop) & (F.col(index) < threshold)
        flag = F.when(F.col(index).isNull() | dark(F.col(blue), limit), True).when(F.col("neighbours") < LEAST_NEIGHBOURS, False).otherwise(low)
        out = out.withColumn(f"excluded_{strategy}", flag)
    return out


def exclusion_counts(flagged: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return flagged.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(f"excluded_{s}").alias(f"n_excluded_{s}") for s in STRATEGIES])


def keep(flagged: DataFrame, strategy: str | None) -> DataFrame:
    """Rows that the strategy keeps; None keeps all."""
    return flagged if strategy is None else flagged.filter(~F.col(f"excluded_{strategy}"))


def without(rows: DataFrame, excluded: DataFrame | None, on: list[str]) -> DataFrame:
    """Rows whose key isn't excluded; without a screening table nothing is."""
    return rows if excluded is None else rows.join(excluded.select(*on).distinct(), on, "left_anti")


def site_sample(pixels: DataFrame, scene: list[str], row: Column, col: Column) -> DataFrame:
    """Per scene the means over the 3 x 3 pixels about (row, col), clipped at the edges: NDVI of pixels, and bands where it is valid.

    A scene without a valid pixel has nulls; so has one whose site lies outside.
    """
    near = pixels.filter(F.col("row").between(row - 1, row + 1) & F.col("col").between(col - 1, col + 1))
    valid = positive(F.col("b04")) & positive(F.col("b8a"))
    bands = [F.avg(F.when(valid, F.col(b))).alias(b) for b in ("b02", "b03", "b04", "b8a")]
    return near.groupBy(*scene).agg(F.avg(ndvi(F.col("b04"), F.col("b8a"))).alias("ndvi"), *bands)


def site_gcc(pixels: DataFrame, scene: list[str], row: Column, col: Column) -> DataFrame:
    from ..functions.indices import gcc

    near = pixels.filter(F.col("row").between(row - 1, row + 1) & F.col("col").between(col - 1, col + 1))
    return near.groupBy(*scene).agg(F.avg(gcc(F.col("b02"), F.col("b03"), F.col("b04"))).alias("greenness_index"))


def screened(pixels: DataFrame, sites: DataFrame, grids: DataFrame, limit: Column | float, keys: tuple[str, ...] = ("site", "source"), zone: int = 32) -> DataFrame:
    """Screening from rasters to flags: the 3 x 3 sample about the site of every scene, its index and its exclusion by all strategies.

    pixels(keys, date, filename, row, col, bands); sites(site, lon, lat) and grids(site, x0, y0, dx, dy) of the zone. Scenes whose
    grid lacks the site have no row, scenes without a valid pixel there are excluded.
    """
    east, north = to_utm(F.col("lon"), F.col("lat"), zone)
    at = sites.join(grids, "site")
    row, col = pixel_of(east, north, *[F.col(c) for c in ("x0", "y0", "dx", "dy")])
    at = at.select("site", row.alias("_row"), col.alias("_col"))
    scene = [*keys, "date", "filename"]
    sampled = site_sample(pixels.join(at, "site"), scene, F.col("_row"), F.col("_col"))
    return flag_exclusions(sampled.withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date"))), limit, keys)
