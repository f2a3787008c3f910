"""Records as JSON and CSV, and nested documents as one JSON text per key. Sizes follow site-seasons, not pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the export and their order, and the names of the season's dates (fixed values).
EXPORT = ("date", "filename", "ndvi", "greenness_index", "b02", "b03", "b04", "b8a")
SEASON_DATES = ("green_up_50pct_date", "green_down_50pct_date")


def records_json(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).json(path)


def records_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = EXPORT, partition_by: tuple[str, ...] = ()) -> None:
    """Fixed columns with a header; quotes within values are doubled."""
    rows.select(*columns, *[c for c in partition_by if c not in columns]).write.mode("overwrite").partitionBy(*partition_by).option("header", True).option("escape", '"').csv(path)


def document(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """One JSON array per key, records in order."""
    record = F.struct(*order, F.struct(*fields).alias("_r"))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(record)).alias("_l")).select(*keys, F.to_json(F.transform("_l", lambda x: x["_r"])).alias(name))


def nested(rows: DataFrame, keys: list[str], name: Column, value: Column, column: str) -> DataFrame:
    """One JSON object per key, from names and values."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(name.alias("key"), value.alias("value")))))
    return rows.groupBy(*keys).agg(F.to_json(entries).alias(column))


def ordered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a key together and in order, for sinks that write a file per key; a key's rows are one series, never pixels."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def manifest(entries: DataFrame, path: str) -> None:
    """One document per site and season: its gap entries by length, and by prediction day where lengths repeat."""
    fields = [c for c in entries.columns if c not in ("site", "season")]
    listed = F.sort_array(F.collect_list(F.struct("gap_days", "prediction_date", F.struct(*fields).alias("_e"))))
    documents = entries.groupBy("site", "season").agg(listed.alias("_l")).select("site", "season", F.transform("_l", lambda x: x["_e"]).alias("entries"))
    documents.write.mode("overwrite").json(path)


def product_path(product: Column, strategy: Column, mode: Column, sigma: Column) -> Column:
    """The folder of a product: its strategy, the index-first mode, and any width of the kernel but the usual 20."""
    wide = F.when(sigma != 20, F.concat(F.lit("_sigma"), sigma.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("prepared_"), strategy, F.when(mode == "itb", F.lit("_itb")).otherwise(F.lit("")), F.lit("/"), product, wide)


def tiles(rows: DataFrame, path: str) -> None:
    """Raster tiles with their header and tags, by site and season."""
    rows.write.mode("overwrite").partitionBy("site", "season").option("compression", "zstd").parquet(path)


def sidecar(seasons: DataFrame, name: str = "document") -> DataFrame:
    """One JSON text per site and season with its two dates, null where they are not known; seasons(site, season, green_up, green_down)."""
    record = F.struct(F.col("green_up").alias(SEASON_DATES[0]), F.col("green_down").alias(SEASON_DATES[1]))
    return seasons.select("site", "season", F.to_json(record, {"ignoreNullFields": "false"}).alias(name))


def run_summary(results: DataFrame, crossover: DataFrame, scenario: str, command_line: list[str], revision: str | None = None, name: str = "document") -> DataFrame:
    """One JSON text per site and season of a validation run: how it was made, its entries by gap with their scores or errors, and the crossover.

    results as of gap.results; crossover(site, season, crossover_days). Entries without scores stay, with the reason.
    """
    keys = ["site", "season"]
    fields = [c for c in results.columns if c not in keys]
    listed = F.transform(F.sort_array(F.collect_list(F.struct("gap_days", F.struct(*fields).alias("_e")))), lambda x: x["_e"]).alias("results")
    made = [F.lit(scenario).alias("scenario"), F.array(*[F.lit(a) for a in command_line]).alias("command_line"), F.lit(revision).cast("string").alias("revision")]
    out = results.groupBy(*keys).agg(listed).join(crossover.select(*keys, "crossover_days"), keys, "left")
    return out.select(*keys, F.to_json(F.struct(*keys, *made, "results", "crossover_days"), {"ignoreNullFields": "false"}).alias(name))
