"""Rasters as tables: tiles of band arrays, pixels with a row and a column, and joins between grids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ("b02", "b03", "b04", "b8a")
OUTLIER, VALID = 5.0, 0.001


def explode_tiles(tiles: DataFrame, keys: list[str], array: str, width: int | Column, height: int | Column, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """Pixel rows of tiles that hold one band after another, row by row: no shuffle, each tile yields its own pixels."""
    size = width * height
    each = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("_p")
    width, size = F.lit(width).alias("_w"), F.lit(size).alias("_n")
    places = tiles.select(*keys, array, width, size, each)
    width, size = F.col("_w"), F.col("_n")
    return places.select(*keys, F.floor(F.col("_p") / width).cast("int").alias("row"), (F.col("_p") % width).cast("int").alias("col"), *[F.get(F.col(array), F.col("_p") + k * size).cast("double").alias(b) for k, b in enumerate(bands)])


def stack(pixels: DataFrame, keys: list[str], bands: tuple[str, ...] = BANDS, array: str = "bands") -> DataFrame:
    """One tile per scene of its pixels, the inverse of explode_tiles: one band after another, row by row; a tile is one row's array."""
    listed = F.sort_array(F.collect_list(F.struct("row", "col", F.struct(*bands).alias("_v"))))
    held = pixels.groupBy(*keys).agg(listed.alias("_l")).select(*keys, F.col("_l._v").alias("_v"))
    return held.select(*keys, F.flatten(F.array(*[F.col(f"_v.{b}") for b in bands])).alias(array))


def composite(acquisitions: DataFrame, keys: list[str], bands: tuple[str, ...] = BANDS, acquisition: str = "acquisition") -> DataFrame:
    """Same-day mean of each pixel over acquisitions. With several a day, pixels whose mean over bands is 5 or more in size don't count; a single one passes as it is."""
    level = F.abs(sum((F.col(b) for b in bands[1:]), F.col(bands[0])) / len(bands))
    cells = keys + [c for c in ("row", "col") if c in acquisitions.columns and c not in keys]
    scenes = acquisitions.groupBy(*keys).agg(F.min(acquisition).alias("_first"), F.max(acquisition).alias("_last"))
    many = scenes.select(*keys, (F.col("_first") != F.col("_last")).alias("_many"))
    means = [F.avg(F.when(level < OUTLIER, F.col(b))).alias(b) for b in bands] + [F.avg(b).alias(f"_all_{b}") for b in bands]
    return acquisitions.groupBy(*cells).agg(*means).join(many, keys).select(*cells, *[F.when(F.col("_many"), F.col(b)).otherwise(F.col(f"_all_{b}")).alias(b) for b in bands])


def valid(bands: tuple[str, ...] = BANDS, any_band: bool = True) -> Column:
    """Whether a pixel holds a value: any band above 0.001, or with any_band false all finite and the largest above it."""
    good = [F.coalesce((F.col(b) > VALID) & ~F.isnan(b), F.lit(False)) for b in bands]
    if any_band:
        out = good[0]
        for g in good[1:]:
            out = out | g
        return out
    known = F.lit(True)
    for b in bands:
        known = known & F.col(b).isNotNull() & ~F.isnan(b)
    return known & (F.greatest(*[F.col(b) for b in bands]) > VALID)


def extent(pixels: DataFrame, scene: list[str], is_valid: Column) -> DataFrame:
    """Rows and columns that hold valid pixels, per scene."""
    return pixels.filter(is_valid).groupBy(*scene).agg(F.min("row").alias("row_0"), F.max("row").alias("row_1"), F.min("col").alias("col_0"), F.max("col").alias("col_1"))


def crop(pixels: DataFrame, scene: list[str], bounds: DataFrame) -> DataFrame:
    """Pixels within their scene's bounds, numbered from its corner."""
    inside = pixels.join(bounds, scene).filter(F.col("row").between(F.col("row_0"), F.col("row_1")) & F.col("col").between(F.col("col_0"), F.col("col_1")))
    moved = inside.withColumn("row", F.col("row") - F.col("row_0")).withColumn("col", F.col("col") - F.col("col_0"))
    return moved.drop("row_0", "row_1", "col_0", "col_1")


def fine_grid(coarse: DataFrame, scene: list[str], width: int, height: int, ratio: int) -> DataFrame:
    """The pixels of a grid `ratio` times as fine, for every scene."""
    rows = F.explode(F.sequence(F.lit(0), F.lit(height * ratio - 1)))
    cols = F.explode(F.sequence(F.lit(0), F.lit(width * ratio - 1)))
    return coarse.select(*scene).distinct().withColumn("row", rows).withColumn("col", cols)


def resample_nearest(coarse: DataFrame, scene: list[str], ratio: int, values: list[str]) -> DataFrame:
    """Each coarse pixel over its ratio x ratio fine pixels; the nearest of a fine centre is the one that it lies in."""
    offsets = F.explode(F.sequence(F.lit(0), F.lit(ratio * ratio - 1))).alias("_k")
    out = coarse.select(*scene, "row", "col", *values, offsets)
    return out.select(*scene, (F.col("row") * ratio + F.floor(F.col("_k") / ratio)).cast("int").alias("row"), (F.col("col") * ratio + F.col("_k") % ratio).cast("int").alias("col"), *values)


def resample(coarse: DataFrame, scene: list[str], width: int, height: int, ratio: int, value: str, kernel: str = "bilinear") -> DataFrame:
    """Weighted mean of the coarse neighbours of each fine centre; null neighbours don't count and the rest are renormalised.

    Every coarse pixel sends its weighted value to the fine pixels in its reach, which sum them: one aggregation and no join.
    Beyond the edge there are no neighbours. Kernels: bilinear (reach 1) and cubic (reach 2, a = -0.5).
    """
    reach = {"bilinear": 1, "cubic": 2}[kernel]
    span = reach * ratio

    def weight(fine: Column, at: Column) -> Column:
        x = F.abs((fine + 0.5) / ratio - 0.5 - at)
        if kernel == "bilinear":
            return F.greatest(F.lit(0.0), 1 - x)
        near, far = 1.5 * x * x * x - 2.5 * x * x + 1, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
        return F.when(x < 1, near).when(x < 2, far).otherwise(0.0)

    def reached(at: str, size: int) -> Column:
        first, last = F.floor((F.col(at) + 0.5) * ratio).cast("int") - span - 1, F.floor((F.col(at) + 0.5) * ratio).cast("int") + span
        return F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(size * ratio - 1))))

    sent = coarse.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*scene, "row", "col", value, reached("row", height).alias("_r"))
    sent = sent.withColumn("_c", reached("col", width)).withColumn("_w", weight(F.col("_r"), F.col("row")) * weight(F.col("_c"), F.col("col"))).filter("_w <> 0")
    summed = sent.groupBy(*scene, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.sum(F.col("_w") * F.col(value)).alias("_v"), F.sum("_w").alias("_s"))
    return summed.select(*scene, "row", "col", F.try_divide("_v", "_s").alias(value))


def cloud_distance(cells: DataFrame, scene: list[str], clear: str) -> DataFrame:
    """Distance of each cell to its scene's nearest cloudy one, 0 on it; null where the scene has none.

    Exact and in time linear in the cells: the nearest cloudy row of each column by a window, then along each row the lower
    envelope of the parabolas that stand on its columns. A row of a raster is one array, whole rasters are never gathered. Cells
    that a scene lacks between its first and last row and column are neither clear nor cloudy and have no row.
    """
    box = cells.groupBy(*scene).agg(F.min("row").alias("_a"), F.max("row").alias("_b"), F.min("col").alias("_c"), F.max("col").alias("_d"))
    every = box.select(*scene, "_c", "_d", F.explode(F.sequence("_a", "_b")).alias("row")).select(*scene, "row", F.explode(F.sequence("_c", "_d")).alias("col"))
    cells = every.join(cells.select(*scene, "row", "col", F.col(clear).alias(clear), F.lit(True).alias("_real")), [*scene, "row", "col"], "left")
    line = Window.partitionBy(*scene, "col").orderBy("row")
    cloudy = F.when(~F.col(clear), F.col("row"))
    above, below = (f("_k", True).over(line.rowsBetween(*frame)) for f, frame in ((F.last, (Window.unboundedPreceding, 0)), (F.first, (0, Window.unboundedFollowing))))
    down = cells.select(*scene, "row", "col", "_real", cloudy.alias("_k")).select(*scene, "row", "col", F.coalesce("_real", F.lit(False)).alias("_real"), F.least(F.col("row") - above, below - F.col("row")).cast("double").alias("_g"))
    packed = down.groupBy(*scene, "row").agg(F.sort_array(F.collect_list(F.struct("col", "_g", "_real"))).alias("_l"))
    kinds = [f"{k} {packed.schema[k].dataType.simpleString()}" for k in (*scene, "row")]
    out = packed.mapInArrow(_along_rows(len(scene) + 1), ", ".join([*kinds, f"col {cells.schema['col'].dataType.simpleString()}", "distance double"]))
    return out


def _along_rows(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(n_keys)
            flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
            place, g = flat.field("col").to_numpy(), flat.field("_g").to_numpy(zero_copy_only=False).astype(float)
            start, d = np.concatenate([[0], np.cumsum(size)]), np.full(len(g), np.nan)
            for n in np.unique(size):  # rows of one length go together
                rows = np.flatnonzero(size == n)
                at = start[rows][:, None] + np.arange(n)
                d[at] = np.sqrt(lower_envelope(place[at].astype(float), g[at] ** 2))
            real = flat.field("_real").to_numpy(zero_copy_only=False)
            each, d = pa.array(np.repeat(np.arange(b.num_rows), size)[real]), d[real]
            columns = [b.column(k).take(each) for k in range(n_keys)] + [pa.array(place[real]), pa.array(d, mask=np.isnan(d))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:n_keys], "col", "distance"])

    return run


def lower_envelope(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """min over j of (x_i - x_j)^2 + h_j of each row, for places x that rise along the row; nan heights don't count, nan where there are none.

    Parabolas are stacked from the left; one that a later one undercuts before its own span begins is taken off again. Rows are
    swept together, so the steps follow the length of a row, not their number.
    """
    m, n = x.shape
    stack, left = np.zeros((m, n), int), np.full((m, n + 1), np.inf)
    top, rows = np.full(m, -1), np.arange(m)
    for j in range(n):
        live = rows[~np.isnan(h[:, j])]
        cut = np.full(m, -np.inf)
        while len(live):
            some = live[top[live] >= 0]
            k = stack[some, top[some]]
            cut[live] = -np.inf
            cut[some] = ((h[some, j] + x[some, j] ** 2) - (h[some, k] + x[some, k] ** 2)) / (2 * (x[some, j] - x[some, k]))
            under = some[cut[some] <= left[some, top[some]]]
            done = np.setdiff1d(live, under, assume_unique=True)
            top[done] += 1
            stack[done, top[done]], left[done, top[done]], left[done, top[done] + 1] = j, cut[done], np.inf
            top[under] -= 1
            live = under
    out, at = np.full((m, n), np.nan), np.zeros(m, int)
    known = rows[top >= 0]
    for j in range(n):
        live = known
        while len(live):
            live = live[(at[live] < top[live]) & (left[live, np.minimum(at[live] + 1, n)] < x[live, j])]
            at[live] += 1
        k = stack[known, at[known]]
        out[known, j] = (x[known, j] - x[known, k]) ** 2 + h[known, k]
    return out


def rescale_distance(distances: DataFrame, scene: list[str]) -> DataFrame:
    """In a scene whose largest distance is at most 1, positive distances become 2, so that its pixels weigh something."""
    top = F.max("distance").over(Window.partitionBy(*scene))  # cells of a coarse raster; the distances are not computed twice
    return distances.withColumn("_top", top).withColumn("distance", F.when((F.col("_top") <= 1) & (F.col("distance") > 0), 2.0).otherwise(F.col("distance"))).drop("_top")


def stretch_range(pixels: DataFrame, scene: list[str], value: str) -> DataFrame:
    """Pixels with their scene's range of positive values."""
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) > 0), F.col(value))
    ranges = pixels.groupBy(*scene).agg(F.min(good).alias("low"), F.max(good).alias("high"))
    return pixels.join(ranges, scene)


# -- positions


_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the series of Krueger to the third order: to the plane, back, and from conformal to geographic latitude.
_TO_PLANE = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_FROM_PLANE = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _conformal(phi: Column) -> Column:
    root = 2 * math.sqrt(_N) / (1 + _N)
    return F.sinh(F.atanh(F.sin(phi)) - root * F.atanh(root * F.sin(phi)))


def _on_sphere(t: Column, lam: Column) -> tuple[Column, Column]:
    return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))


def _to_plane(xi: Column, eta: Column) -> tuple[Column, Column]:
    east, north = eta, xi
    for k, c in enumerate(_TO_PLANE, 1):
        east = east + c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return 500_000 + _RADIUS * east, _RADIUS * north


def _from_plane(xi: Column, eta: Column) -> tuple[Column, Column]:
    x, y = xi, eta
    for k, c in enumerate(_FROM_PLANE, 1):
        x = x - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return x, y


def _geographic(chi: Column) -> Column:
    return sum((c * F.sin(2 * k * chi) for k, c in enumerate(_LATITUDE, 1)), chi)


def to_utm(lon: Column, lat: Column, zone: int = 32) -> tuple[Column, Column]:
    """Easting and northing on WGS 84; good to millimetres within the zone."""
    return _to_plane(*_on_sphere(_conformal(F.radians(lat)), F.radians(lon - (6 * zone - 183))))


def between_zones(rows: DataFrame, x: str, y: str, zone: str, other: str, names: tuple[str, str]) -> DataFrame:
    """rows with a position of one zone in another one's coordinates, as `names`; as it is where the zones are the same.

    The steps are columns of their own, as each uses the one before several times over; the last is a generator's output, so that
    no filter on it is pushed down and multiplied through them.
    """
    step = lambda df, **named: df.withColumns({f"_{k}": c for k, c in named.items()})
    out = step(rows, xi=F.col(y) / _RADIUS, eta=(F.col(x) - 500_000) / _RADIUS)
    a, e = _from_plane(F.col("_xi"), F.col("_eta"))
    out = step(out, a=a, e=e)
    out = step(out, chi=F.asin(F.sin("_a") / F.cosh("_e")), lam=F.atan2(F.sinh("_e"), F.cos("_a")) + F.radians(6 * (F.col(zone) - F.col(other)).cast("double")))
    out = step(out, phi=_geographic(F.col("_chi")))
    out = step(out, t=_conformal(F.col("_phi")))
    xi, eta = _on_sphere(F.col("_t"), F.col("_lam"))
    out = step(out, xi=xi, eta=eta)
    east, north = _to_plane(F.col("_xi"), F.col("_eta"))
    out = step(out, east=east, north=north)
    same = F.col(zone) == F.col(other)
    moved = F.struct(F.when(same, F.col(x)).otherwise(F.col("_east")).alias(names[0]), F.when(same, F.col(y)).otherwise(F.col("_north")).alias(names[1]))
    return out.select(*rows.columns, F.inline(F.array(moved)))


def pixel_of(x: Column, y: Column, x0: Column, y0: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """(row, col) of a position in a grid with its upper left corner at (x0, y0) and positive cell sizes."""
    return F.floor((y0 - y) / dy).cast("int"), F.floor((x - x0) / dx).cast("int")


def bbox(lon: Column, lat: Column, size: float) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a box of `size` degrees about a point."""
    return lon - size / 2, lat - size / 2, lon + size / 2, lat + size / 2


def resample_to(pixels: DataFrame, scene: list[str], size: tuple[int, int], target: tuple[int, int], values: list[str], kernel: str = "bilinear") -> DataFrame:
    """Weighted means of several values on a grid of any other size over the same extent; sizes are (height, width).

    To a coarser grid the kernel is stretched to the cells of it, so that every fine pixel counts. Nulls don't count and the
    rest are renormalised, each value by itself. A pixel sends its values to the cells in its reach: one aggregation, no join.
    """
    reach = {"bilinear": 1, "cubic": 2}[kernel]

    def steps(at: str, n: int, m: int) -> tuple[Column, Callable[[Column], Column]]:
        ratio, wide = m / n, max(1.0, n / m)
        centre = (F.col(at) + 0.5) * ratio - 0.5  # in target cells
        first, last = F.ceil(centre - reach * wide * ratio).cast("int"), F.floor(centre + reach * wide * ratio).cast("int")

        def weight(cell: Column) -> Column:
            x = F.abs((cell + 0.5) / ratio - 0.5 - F.col(at)) / wide
            if kernel == "bilinear":
                return F.greatest(F.lit(0.0), 1 - x)
            near, far = 1.5 * x * x * x - 2.5 * x * x + 1, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
            return F.when(x < 1, near).when(x < 2, far).otherwise(0.0)

        return F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(m - 1)))), weight

    (rows, row_weight), (cols, col_weight) = steps("row", size[0], target[0]), steps("col", size[1], target[1])
    sent = pixels.select(*scene, "row", "col", *values, rows.alias("_r")).withColumn("_c", cols)
    sent = sent.withColumn("_w", row_weight(F.col("_r")) * col_weight(F.col("_c"))).filter("_w <> 0")
    known = lambda v: F.col(v).isNotNull() & ~F.isnan(v)
    means = [F.try_divide(F.sum(F.when(known(v), F.col("_w") * F.col(v))), F.sum(F.when(known(v), F.col("_w")))).alias(v) for v in values]
    return sent.groupBy(*scene, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(*means)


def in_grid(row: Column, col: Column, height: int, width: int) -> Column:
    """Whether a position lies in the grid, borders included; a null one does not."""
    return F.coalesce(row.between(0, height - 1) & col.between(0, width - 1), F.lit(False))


def pixel_sample(pixels: DataFrame, scene: list[str], row: Column, col: Column, values: list[str], nodata: float = 0.0) -> DataFrame:
    """Per scene the values of one pixel, null where they are nodata; scenes whose grid lacks the pixel have no row."""
    at = pixels.filter((F.col("row") == row) & (F.col("col") == col))
    return at.select(*scene, *[F.when(F.col(v).isNotNull() & ~F.isnan(v) & (F.col(v) != nodata), F.col(v)).alias(v) for v in values])


def to_lonlat(east: Column, north: Column, zone: int = 32) -> tuple[Column, Column]:
    """Longitude and latitude of a northern UTM position: the inverse of to_utm."""
    x, y = _from_plane(north / _RADIUS, (east - 500_000) / _RADIUS)
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (6 * zone - 183), F.degrees(_geographic(F.asin(F.sin(x) / F.cosh(y))))


def envelope_window(corners: list[tuple[Column, Column]], west: Column, south: Column, east: Column, north: Column, dx: Column, dy: Column) -> tuple[Column, Column, Column, Column]:
    """(row, col, height, width) in pixels, with fractions, of the box about the corners within a raster's bounds.

    Corners are in the raster's own coordinates. Height or width is 0 or less where the box lies outside.
    """
    xs, ys = [x for x, _ in corners], [y for _, y in corners]
    left, right = F.greatest(F.least(*xs), west), F.least(F.greatest(*xs), east)
    low, high = F.greatest(F.least(*ys), south), F.least(F.greatest(*ys), north)
    return (north - high) / dy, (left - west) / dx, (high - low) / dy, (right - left) / dx
