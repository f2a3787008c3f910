"""Rasters as tiles along a space-filling curve, so that a window of a raster is a few ranges of one column.

A tile's key interleaves the bits of its column and row (Morton order). Tiles are written sorted by key in small row groups; a
window becomes ranges of keys, which Parquet compares with the bounds of its row groups, and then the exact tiles and pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import BANDS, explode_tiles

BITS = 24  # of a tile's column and of its row
RANGES = 16
ROW_GROUP = 128 * 1024


def tile_key(tile_row: Column, tile_col: Column) -> Column:
    out = F.lit(0).cast("long")
    for k in range(BITS):
        bit = lambda x, k=k: F.shiftright(x.cast("long"), k).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit(tile_col), 2 * k)).bitwiseOR(F.shiftleft(bit(tile_row), 2 * k + 1))
    return out


def key_ranges(row_0: int, row_1: int, col_0: int, col_1: int, most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges of keys, both ends included, that hold all tiles of a box (bounds included), and few others.

    Squares of the curve that lie in the box are ranges; those that lie partly in it are cut in four, until there are too many.
    The narrowest gaps between ranges are closed then.
    """
    found: list[tuple[int, int]] = []
    squares = [(0, 0, BITS)]
    while squares:
        rest = []
        for r, c, k in squares:
            side = 1 << k
            if r > row_1 or c > col_1 or r + side <= row_0 or c + side <= col_0:
                continue
            if (row_0 <= r and r + side - 1 <= row_1 and col_0 <= c and c + side - 1 <= col_1) or len(rest) + len(found) > 8 * most:
                first = _key(r, c)
                found.append((first, first + side * side - 1))
            else:
                half = side // 2
                rest += [(r, c, k - 1), (r, c + half, k - 1), (r + half, c, k - 1), (r + half, c + half, k - 1)]
        squares = rest
    found.sort()
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    while len(merged) > most:
        k = min(range(len(merged) - 1), key=lambda i: merged[i + 1][0] - merged[i][1])
        merged[k : k + 2] = [[merged[k][0], merged[k + 1][1]]]
    return [(a, b) for a, b in merged]


def _key(row: int, col: int) -> int:
    return sum(((col >> k & 1) << 2 * k) | ((row >> k & 1) << 2 * k + 1) for k in range(BITS))


def write_tiles(tiles: DataFrame, path: str, scene: list[str], files: int | None = None, row_group: int = ROW_GROUP) -> None:
    """tiles(scene, tile_row, tile_col, bands) laid out by key, then scene, over files of disjoint ranges."""
    keyed = tiles.withColumn("tile_key", tile_key(F.col("tile_row"), F.col("tile_col")))
    dealt = keyed.repartitionByRange(files, "tile_key", *scene) if files else keyed.repartitionByRange("tile_key", *scene)
    dealt.sortWithinPartitions("tile_key", *scene).write.option("parquet.block.size", row_group).option("compression", "zstd").parquet(path)


def read_window(spark: SparkSession, path: str, scene: list[str], row_0: int, row_1: int, col_0: int, col_1: int, width: int, height: int, bands: tuple[str, ...] = BANDS, array: str = "bands") -> DataFrame:
    """Pixels of a window (bounds included, in pixels of the whole raster) of all scenes: (scene, row, col, bands).

    Tiles are width x height pixels. Only row groups whose keys meet the window's ranges are read, and only the named bands.
    """
    box = row_0 // height, row_1 // height, col_0 // width, col_1 // width
    if row_1 < row_0 or col_1 < col_0 or row_1 < 0 or col_1 < 0:
        box = 1, 0, 1, 0
    near = F.lit(False)
    for a, b in key_ranges(max(box[0], 0), box[1], max(box[2], 0), box[3]):
        near = near | F.col("tile_key").between(a, b)
    inside = F.col("tile_row").between(box[0], box[1]) & F.col("tile_col").between(box[2], box[3])
    tiles = spark.read.parquet(path).filter(near & inside)
    px = explode_tiles(tiles, [*scene, "tile_row", "tile_col"], array, width, height, bands)
    row, col = F.col("tile_row") * height + F.col("row"), F.col("tile_col") * width + F.col("col")
    placed = px.select(*scene, row.cast("int").alias("row"), col.cast("int").alias("col"), *bands)
    return placed.filter(F.col("row").between(row_0, row_1) & F.col("col").between(col_0, col_1))
