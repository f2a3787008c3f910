"""Warps between grids of other bounds, cell sizes and UTM zones, by inverse mapping.

A grid is a row of its keys with `zone, x0, y0, dx, dy, height, width`: the upper left corner, positive cell sizes, the size in
cells. Where each target cell reads from depends on the two grids only, not on scenes or days: the cell's centre goes to its
longitude and latitude and on to the source's zone, which gives a fractional source cell, the neighbours about it and their
weights. Scenes then meet these neighbours by an equi-join on the source cell, and one aggregation ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import between_zones

GRID = ("zone", "x0", "y0", "dx", "dy", "height", "width")
#: How many source cells a kernel reaches to either side.
REACH = {"nearest": 0, "bilinear": 1, "cubic": 2}


def refined(grids: DataFrame, ratio: int) -> DataFrame:
    """The grids of the same bounds with cells `ratio` times as fine."""
    fine = {"dx": F.col("dx") / ratio, "dy": F.col("dy") / ratio, "height": (F.col("height") * ratio).cast("int"), "width": (F.col("width") * ratio).cast("int")}
    return grids.select(*[fine[c].alias(c) if c in fine else F.col(c) for c in grids.columns])


def cells(grids: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of every grid with its centre: (keys, zone, row, col, x, y)."""
    rows = F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row")
    out = grids.filter("height > 0 and width > 0").select(*keys, *GRID, rows).select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    return out.select(*keys, "zone", "row", "col", (F.col("x0") + (F.col("col") + 0.5) * F.col("dx")).alias("x"), (F.col("y0") - (F.col("row") + 0.5) * F.col("dy")).alias("y"))


def kernel_weight(away: Column, kernel: str) -> Column:
    """The textbook kernels; away in source cells, or in target cells where those are wider."""
    if kernel == "nearest":
        return F.lit(1.0)
    x = F.abs(away)
    if kernel == "bilinear":
        return F.greatest(F.lit(0.0), 1 - x)
    near, far = 1.5 * x * x * x - 2.5 * x * x + 1, -0.5 * x * x * x + 2.5 * x * x - 4 * x + 2
    return F.when(x < 1, near).when(x < 2, far).otherwise(0.0)


def neighbours(source: DataFrame, target: DataFrame, keys: list[str], kernel: str = "bilinear") -> DataFrame:
    """(keys, row, col, source_row, source_col, weight) of the grids of a key, one of each kind: what every target cell reads.

    Target cells whose centre lies outside the source's bounds read nothing. Kernels widen with the cells of a coarser target, so
    that every source cell counts. Weights of a target cell need not add up to 1; `warp` divides by those of known values.
    """
    s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in GRID])
    t = cells(target.select(*keys, *GRID), keys).join(target.select(*keys, F.col("dx").alias("_tx"), F.col("dy").alias("_ty")), keys).join(s, keys)
    t = between_zones(t, "x", "y", "zone", "_zone", ("_px", "_py"))
    t = t.withColumn("_c", (F.col("_px") - F.col("_x0")) / F.col("_dx")).withColumn("_r", (F.col("_y0") - F.col("_py")) / F.col("_dy"))
    t = t.filter((F.col("_r") >= 0) & (F.col("_r") < F.col("_height")) & (F.col("_c") >= 0) & (F.col("_c") < F.col("_width")))
    if kernel == "nearest":
        return t.select(*keys, "row", "col", F.floor("_r").cast("int").alias("source_row"), F.floor("_c").cast("int").alias("source_col"), F.lit(1.0).alias("weight"))
    wide = {"r": F.greatest(F.lit(1.0), F.col("_ty") / F.col("_dy")), "c": F.greatest(F.lit(1.0), F.col("_tx") / F.col("_dx"))}

    def about(axis: str, size: str) -> Column:
        centre, reach = F.col(f"_{axis}") - 0.5, REACH[kernel] * wide[axis]
        first, last = F.greatest(F.ceil(centre - reach), F.lit(0)), F.least(F.floor(centre + reach), F.col(size) - 1)
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    each = t.withColumn("source_row", about("r", "_height")).withColumn("source_col", about("c", "_width"))
    weight = kernel_weight((F.col("source_row") + 0.5 - F.col("_r")) / wide["r"], kernel) * kernel_weight((F.col("source_col") + 0.5 - F.col("_c")) / wide["c"], kernel)
    return each.select(*keys, "row", "col", "source_row", "source_col", weight.alias("weight")).filter("weight <> 0")


def warp(pixels: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], scene: list[str], values: list[str], kernel: str = "bilinear") -> DataFrame:
    """pixels(scene, row, col, values) of the source grids on the target grids: (scene, row, col, values).

    `keys` are the columns of `scene` that the grids have, one source and one target grid each. Null and NaN values don't count
    and the rest are renormalised, each value by itself; a target cell without a known value has null, one that reads no pixel
    of the scene no row.
    """
    near = neighbours(source, target, keys, kernel).withColumnsRenamed({"row": "_row", "col": "_col", "source_row": "row", "source_col": "col"})
    met = pixels.select(*scene, "row", "col", *values).join(near, [*keys, "row", "col"])
    if kernel == "nearest":
        return met.select(*scene, F.col("_row").alias("row"), F.col("_col").alias("col"), *[F.when(~F.isnan(F.col(v).cast("double")), F.col(v)).alias(v) for v in values])
    known = lambda v: F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    means = [F.try_divide(F.sum(F.when(known(v), F.col("weight") * F.col(v))), F.sum(F.when(known(v), F.col("weight")))).alias(v) for v in values]
    return met.groupBy(*scene, F.col("_row").alias("row"), F.col("_col").alias("col")).agg(*means)
