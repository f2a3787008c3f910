"""Line deduplication by levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at both ends and with A-Z in lower case; it stands for itself by 128 bits of hash.
A run is a table (h1, h2, docs, last), bucketed and sorted by the hash: how many documents of some batches hold the key, and the
largest id among them. A new batch is merged with every run and leaves out what can change nothing any more: keys that a run
already knows to be frequent, with a holder at or beyond the batch's largest. What remains is the batch's own run. Runs of a
level are merged into one of the next as soon as there are `fan_in`. Sums and maxima over all runs are exact at any time, in
whatever order batches come.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder
from .graph import loose

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_POINTS, LEAST_DOCS = 40, 5
BATCHES, FAN_IN = 8, 4


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def folded(x: Column) -> Column:
    """A-Z in lower case and nothing else; the quick way is right where every code point is one byte."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes(key: Column) -> list[Column]:
    """128 bits of a key as two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class Runs:
    """Levelled runs in a folder that the cluster shares. `runs` lists (level, path) and is all there is to keep between sessions."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS, fan_in: int = FAN_IN, runs: list[tuple[int, str]] | None = None, folder: str | None = None):
        self.spark, self.least, self.fan_in = spark, least, fan_in
        self.folder = folder or f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: dict[str, str] = {}
        self.runs: list[tuple[int, str]] = list(runs or [])

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        rows.write.option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self._tables[path] = name
        self.runs.append((level, path))

    def _read(self, path: str) -> DataFrame:
        """The run as a bucketed table, so that merging with it moves none of its rows; one of another session as plain files."""
        return self.spark.table(self._tables[path]) if path in self._tables else self.spark.read.parquet(path)

    def add(self, own: DataFrame) -> None:
        """own(h1, h2, docs, last), one row a key, of documents that no run has counted yet."""
        rest = own.repartition(self.buckets, "h1", "h2")
        for _, path in self.runs:
            known = self._read(path).filter(F.col("docs") >= self.least).select("h1", "h2", F.col("last").alias("_seen"))
            rest = rest.join(known, (rest.h1 == known.h1) & (rest.h2 == known.h2) & (F.col("_seen") >= F.col("last")), "left_anti")
        self._write(rest, 0)
        level = 0
        while sum(n == level for n, _ in self.runs) >= self.fan_in:
            self._compact(level)
            level += 1

    def _merged(self, paths: list[str]) -> DataFrame:
        # keys are computed anew, so that the sum has an exchange of its own: a union of bucketed tables doesn't pair their buckets reliably
        rows = loose(self._read(paths[0]), "h1", "h2")
        for p in paths[1:]:
            rows = rows.unionByName(loose(self._read(p), "h1", "h2"))
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _compact(self, level: int) -> None:
        old = [p for n, p in self.runs if n == level]
        self._write(self._merged(old).repartition(self.buckets, "h1", "h2"), level + 1)
        self.runs = [(n, p) for n, p in self.runs if p not in old]
        self._drop(old)

    def frequent(self) -> DataFrame:
        """(h1, h2, last) of the keys that are in `least` documents or more."""
        return self._merged([p for _, p in self.runs]).filter(F.col("docs") >= self.least).select("h1", "h2", "last")

    def _drop(self, paths: list[str]) -> None:
        for p in paths:
            if p in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(p)}")
            where = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Forget all runs and delete their files."""
        self._drop([p for _, p in self.runs])
        self.runs = []


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS) -> DataFrame:
    """(id, h1, h2): the long enough keys of each row, each once a row."""
    lines = F.filter(lines_of(F.col(text_col)), lambda x: F.char_length(x) >= least_points)
    keys = F.array_distinct(F.transform(F.transform(lines, stripped), folded))
    each = docs.select(F.col(id_col).alias("id"), F.explode(keys).alias("key")).filter(F.char_length("key") >= least_points)
    return each.select("id", *hashes(F.col("key")))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """(h1, h2, last) of all keys in `least_docs` rows of docs or more, checkpointed; rows go through the runs in batches by their id.

    Lines are cut and hashed in one pass over the texts, whose partial sums meet by batch and hash, so that a line that most
    documents hold is one row a task.
    """
    spark = docs.sparkSession
    runs = Runs(spark, least_docs, fan_in)
    own = f"{runs.folder}/batches"
    counted = keys_of(docs, id_col, text_col, least_points).groupBy(F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), "h1", "h2")
    counted.agg(F.count("*").alias("docs"), F.max("id").alias("last")).write.partitionBy("batch").parquet(own)
    held = spark.read.schema(f"h1 long, h2 long, docs long, last {docs.schema[id_col].dataType.simpleString()}, batch int").parquet(own)
    for k in range(batches):
        runs.add(held.filter(F.col("batch") == k).drop("batch"))
    out = cut(runs.frequent())
    runs._drop([own])
    runs.close()
    return out


def without_frequent_lines(docs: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS) -> DataFrame:
    """docs with `dropped`, the sorted places of lines that go (null: none), and `kept`, the text of the others.

    A frequent key stays in the rows whose id is its `last`. Rows are told apart by a hash of id and text; rows equal in both
    lose the same lines. Columns of docs named `dropped` or `kept` are an error; any others pass unchanged.
    """
    clash = sorted({"dropped", "kept"} & set(docs.columns))
    if clash:
        raise ValueError(f"docs already have {clash}")
    mark = [F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), id_col, text_col)]
    one, two = ("_r1" + "_" * max(map(len, docs.columns)), "_r2" + "_" * max(map(len, docs.columns)))  # no column's name
    lines = docs.select(mark[0].alias("r1"), mark[1].alias("r2"), F.col(id_col).alias("id"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    short = stripped(F.col("line"))
    keyed = lines.filter((F.char_length("line") >= least_points) & (F.char_length(short) >= least_points)).select("r1", "r2", "id", "pos", *hashes(folded(short)))
    gone = keyed.join(loose(frequent, "h1", "h2"), ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("last")))
    places = gone.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    places = loose(places, "r1", "r2").withColumnsRenamed({"r1": one, "r2": two})
    rows = docs.withColumn(one, mark[0]).withColumn(two, mark[1]).join(places, [one, two], "left").drop(one, two)
    return rows.withColumn("kept", F.when(F.col("dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(_remaining(lines_of(F.col(text_col)), F.col("dropped"))))


def _remaining(lines: Column, gone: Column) -> Column:
    """The lines between the places that go, joined: one slice a gap, so the time is linear. lines and gone are evaluated once."""

    def joined(x: Column) -> Column:
        n, d = F.size(x["l"]), F.size(x["p"])

        def gap(i: Column) -> Column:
            first = F.when(i == 0, 0).otherwise(F.get(x["p"], i - 1) + 1)
            return F.slice(x["l"], first + 1, F.when(i == d, n).otherwise(F.get(x["p"], i)) - first)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), d), gap)), "\n")

    return F.get(F.transform(F.array(F.struct(lines.alias("l"), gone.alias("p"))), joined), F.lit(0))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with `dropped` and `kept`: keys of at least `least_points` code points in at least `least_docs` rows stay in the largest id only.

    A null or empty text is one empty line. Each row is a document; rows that repeat the largest id all keep a line, and rows
    without an id are below all others. Ids may be of any type with an order, texts and lines of any length. A line that a
    document holds several times counts once, and goes or stays with all its places. An empty table gives no rows.
    """
    return without_frequent_lines(docs, frequent_lines(docs, id_col, text_col, least_points, least_docs), id_col, text_col, least_points)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, its lines before dropping, how many go, and the digest of the text that stays."""
    found = dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    return found.select("doc_id", n_lines.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))
