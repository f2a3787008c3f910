"""The paged listing: what it returns, and how many requests that takes."""

from __future__ import annotations

import datetime as dt
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from verdance.sources import listing

D = dt.date


def logging_source(folder: Path):
    where = str(folder)

    class Logged(listing.PagedListing):
        """Each request leaves a file, whichever process makes it."""

        @classmethod
        def name(cls):
            return f"logged_{Path(where).name.replace('-', '_')}"

        def pages(self):
            pages, ask = super().pages(), listing.ParquetPages.items

            def items(offset, limit):
                Path(where, f"{'page' if limit > 1 else 'item'}-{offset}-{uuid.uuid4().hex}").touch()
                return ask(pages, offset, limit)

            pages.items = items
            return pages

    return Logged


def requests(folder: Path, kind: str) -> int:
    return len(list(folder.glob(f"{kind}-*")))


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = spark.range(20_000).select(F.col("id"), F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 40).cast("int")).alias("imgdate"))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.parquet(path)
    return path


def test_only_pages_about_the_wanted_days_are_read(spark, table, tmp_path):
    folder = tmp_path / "log-a"
    folder.mkdir()
    got = listing.paged_listing(spark, table, "id long, imgdate date", "imgdate", "2020-03-01", "2020-03-05", source=logging_source(folder)).collect()
    assert sorted(r.id for r in got) == list(range(2400, 2600)) and {r.imgdate for r in got} == {D(2020, 3, k) for k in range(1, 6)}
    assert requests(folder, "page") <= 5 and requests(folder, "item") <= 16  # of 200 pages; two searches of eight steps


def test_filters_reach_the_scan(spark, table, tmp_path):
    folder = tmp_path / "log-b"
    folder.mkdir()
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = listing.paged_listing(spark, table, "id long, imgdate date", "imgdate", source=logging_source(folder))
        got = rows.filter((F.col("imgdate") >= F.lit("2021-05-10").cast("date")) & (F.col("imgdate") < F.lit("2021-05-12").cast("date"))).collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert len(got) == 80 and requests(folder, "page") <= 6


def test_whole_and_empty_listings(spark, table, tmp_path):
    assert listing.paged_listing(spark, table, "id long, imgdate date", "imgdate", page_rows=1000).count() == 20_000
    assert listing.paged_listing(spark, table, "id long, imgdate date", "imgdate", "2031-01-01", "2031-02-01").count() == 0
    assert listing.paged_listing(spark, table, "id long, imgdate date", "imgdate", "2010-01-01", "2010-02-01").count() == 0
    none = str(tmp_path / "none")
    spark.range(0).select("id", F.lit(None).cast("date").alias("imgdate")).write.parquet(none)
    assert listing.paged_listing(spark, none, "id long, imgdate date", "imgdate", "2020-01-01").count() == 0


def test_a_task_stops_at_the_first_later_item(spark, tmp_path):
    path = str(tmp_path / "odd")
    days = ["2024-01-01", "2024-01-03", "2024-01-02", None, "2024-01-04", "2024-01-02", "2024-01-05"]
    spark.createDataFrame(list(enumerate(days)), "id long, imgdate string").coalesce(1).write.parquet(path)
    got = listing.paged_listing(spark, path, "id long, imgdate string", "imgdate", "2024-01-02", "2024-01-03", page_rows=3).collect()
    assert sorted(r.id for r in got) == [1, 2]  # the other second of January stands behind a later day
