"""Tiles along the curve: keys, ranges, and how little a window reads."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verdance.sources import tiles


def test_keys_follow_the_curve(spark):
    at = [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (5, 9), (2**24 - 1, 2**24 - 1), (123456, 7654321)]
    got = [r[0] for r in spark.createDataFrame(at, "r int, c int").select(tiles.tile_key(F.col("r"), F.col("c"))).collect()]
    assert got[:5] == [0, 1, 2, 3, 4] and got == [tiles._key(*x) for x in at] and got[6] == 2**48 - 1


def test_ranges_hold_a_box():
    rng = random.Random(1)
    for _ in range(60):
        r, c, h, w = rng.randrange(60), rng.randrange(60), rng.randrange(1, 12), rng.randrange(1, 12)
        for most in (1, 4, 16):
            ranges = tiles.key_ranges(r, r + h - 1, c, c + w - 1, most)
            keys = {tiles._key(i, j) for i in range(r, r + h) for j in range(c, c + w)}
            assert len(ranges) <= most and all(any(a <= k <= b for a, b in ranges) for k in keys)
            assert all(b < a for (_, b), (a, _) in zip(ranges, ranges[1:]))
    assert sum(b - a + 1 for a, b in tiles.key_ranges(3, 18, 5, 9, 64)) == 16 * 5
    assert tiles.key_ranges(1, 0, 1, 0) == [] and len(tiles.key_ranges(1, 2**23, 1, 2**23)) <= 16


def test_window_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    laid = spark.range(4096).select(F.lit(1).alias("scene"), F.floor(F.col("id") / 64).cast("int").alias("tile_row"), (F.col("id") % 64).cast("int").alias("tile_col"), F.transform(F.sequence(F.lit(0), F.lit(4 * 256 - 1)), lambda k: F.rand(3) + k).alias("bands"))
    tiles.write_tiles(laid, path, ["scene"], files=4)
    window = (100, 180, 300, 420)
    got = tiles.read_window(spark, path, ["scene"], *window, 16, 16)
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "tile_key" in plan.split("PushedFilters")[1]
    cells = {(r.row, r.col) for r in got.select("row", "col").collect()}
    assert cells == {(r, c) for r in range(100, 181) for c in range(300, 421)}
    value = {(r.tile_row, r.tile_col): r.bands for r in spark.read.parquet(path).filter("tile_row = 7 and tile_col = 20").collect()}
    one = got.filter("row = 115 and col = 325").first()
    assert one.b02 == value[7, 20][3 * 16 + 5] and one.b8a == value[7, 20][768 + 3 * 16 + 5]
    # by their footers, of all row groups only a few meet the pushed ranges
    ranges, met, n = tiles.key_ranges(100 // 16, 180 // 16, 300 // 16, 420 // 16), 0, 0
    for f in sorted((tmp_path / "t").glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = next(meta.row_group(g).column(c).statistics for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "tile_key")
            met, n = met + any(s.min <= b and a <= s.max for a, b in ranges), n + 1
    assert n >= 32 and met <= n / 6


@pytest.mark.parametrize("window", [(5, 4, 0, 3), (900, 910, 0, 3), (-5, -1, 0, 3)])
def test_windows_outside(spark, tmp_path, window):
    path = str(tmp_path / "t")
    tiles.write_tiles(spark.range(4).select(F.lit(1).alias("scene"), (F.col("id") % 2).cast("int").alias("tile_row"), F.floor(F.col("id") / 2).cast("int").alias("tile_col"), F.array_repeat(F.lit(1.0), 16).alias("bands")), path, ["scene"])
    assert tiles.read_window(spark, path, ["scene"], *window, 2, 2).collect() == []
