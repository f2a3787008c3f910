"""A paged listing as a data source: pages come in the order of a day, one request each, and only those about the wanted days are read.

The driver bisects to the first page by the days of single items, a few requests for a listing of any length, and to the page
after the last; tasks read the pages between, and stop at the first later item. Bounds are options, and filters on the day are
pushed into the scan where the session allows it (spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Items before the first wanted day that are read as well, since a listing is in order only roughly; pages of one task.
SAFETY, PAGES_OF_TASK = 100, 16


class Pages:
    """A listing of `size` items in pages of `length`. A service would answer `items` by offset and limit."""

    size: int
    length: int

    def items(self, offset: int, limit: int) -> pa.Table:
        raise NotImplementedError

    def page(self, k: int) -> pa.Table:
        return self.items(k * self.length, self.length)

    def day(self, k: int, column: str) -> dt.date | None:
        """The day of a page's first item."""
        first = self.items(k * self.length, 1)[column]
        return as_day(first[0].as_py()) if len(first) else None


def as_day(x: Any) -> dt.date | None:
    return x.date() if isinstance(x, dt.datetime) else dt.date.fromisoformat(x[:10]) if isinstance(x, str) else x


class ParquetPages(Pages):
    """The rows of a Parquet file, or of the files of a folder by name, as a listing. Footers tell where a page lies."""

    def __init__(self, path: str, length: int, columns: list[str]):
        files, path = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
        kind = files.get_file_info(path)
        names = [path] if kind.is_file else sorted(i.path for i in files.get_file_info(pyarrow.fs.FileSelector(path)) if i.path.endswith(".parquet"))
        self.length, self.columns, self.size, self._groups = length, columns, 0, []
        for name in names:
            f = pq.ParquetFile(files.open_input_file(name))
            for g in range(f.num_row_groups):
                n = f.metadata.row_group(g).num_rows
                self._groups.append((self.size, self.size + n, f, g))
                self.size += n
        self._held: tuple[int, pa.Table] | None = None

    def items(self, offset: int, limit: int) -> pa.Table:
        parts = []
        for start, stop, f, g in self._groups:
            if start < offset + limit and offset < stop:
                if not self._held or self._held[0] != start:
                    self._held = start, f.read_row_group(g, self.columns)
                parts.append(self._held[1].slice(max(0, offset - start), min(stop, offset + limit) - max(start, offset)))
        return pa.concat_tables(parts) if parts else pa.table({c: [] for c in self.columns})


def first_page(pages: Pages, column: str, day: dt.date, n: int) -> int:
    """The first page that begins on `day` or later; a page without a day ends the search where it stands."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        found = pages.day(mid, column)
        if found is None:
            break
        low, high = (mid + 1, high) if found < day else (low, mid)
    return low


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ListingReader(DataSourceReader):
    def __init__(self, source: PagedListing):
        self.source, o = source, source.options
        self.day = o["day"]
        self.first, self.last = (dt.date.fromisoformat(o[k]) if o.get(k) else None for k in ("first", "last"))

    def partitions(self) -> list[InputPartition]:
        pages = self.source.pages()
        n = -(-pages.size // pages.length)
        back = -(-SAFETY // pages.length)
        start = max(0, first_page(pages, self.day, self.first, n) - 1 - back) if self.first else 0
        stop = min(n, first_page(pages, self.day, self.last + dt.timedelta(1), n) + back) if self.last else n
        return [Range(k, min(k + PAGES_OF_TASK, stop)) for k in range(start, stop, PAGES_OF_TASK)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        pages = self.source.pages() if partition.first < partition.last else None
        for k in range(partition.first, partition.last):
            table = pages.page(k)
            days = [as_day(x) for x in table[self.day].to_pylist()]
            later = next((i for i, d in enumerate(days) if self.last and d and d > self.last), len(days))
            keep = [d is not None and i < later and (not self.first or d >= self.first) for i, d in enumerate(days)]
            yield from table.filter(pa.array(keep, pa.bool_())).to_batches()
            if later < len(days):
                return


class PushedListingReader(ListingReader):
    """One of its own, as a session that doesn't push filters takes no reader that could."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the day narrow the scan. Every filter is left to Spark as well, as days and times compare alike only roughly."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.day,) and f.value is not None:
                day = as_day(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first or day, day)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last or day, day)
            yield f


class PagedListing(DataSource):
    """Options: path, columns (those to read, with their types), day (the column), first and last (ISO days, optional), page_rows, pushed."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return self.options["columns"]

    def pages(self) -> Pages:
        return ParquetPages(self.options["path"], int(self.options.get("page_rows", "100")), [c.split()[0] for c in self.options["columns"].split(", ")])

    def reader(self, schema: StructType) -> ListingReader:
        return (PushedListingReader if self.options.get("pushed") == "true" else ListingReader)(self)


def paged_listing(spark: SparkSession, path: str, columns: str, day: str, first: str | None = None, last: str | None = None, page_rows: int = 100, source: type[PagedListing] = PagedListing) -> DataFrame:
    """Items of a paged listing between two days, both included. Items without a day are passed over.

    A task stops at its first item later than `last`: what a listing holds out of order behind that is not read.
    """
    spark.dataSource.register(source)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    read = spark.read.format(source.name()).options(path=path, columns=columns, day=day, page_rows=str(page_rows), pushed=pushed)
    for name, value in (("first", first), ("last", last)):
        read = read.option(name, value) if value else read
    return read.load()
