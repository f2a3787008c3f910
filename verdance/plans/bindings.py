"""The driver's tables read as acquisitions, series and tiles; for each a DataFrame and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def acq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as acquisitions of a site (supplier) by a source (status)."""
    date = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.col("l_linestatus").alias("source"), date.alias("date"), F.datediff(date, F.lit("1995-01-01").cast("date")).alias("day"),
        F.concat(F.lit("S2A_MSIL2A_"), F.date_format(date, "yyyyMMdd"), F.lit("_REFL.tif")).alias("filename"), F.col("l_tax").alias("b02"), F.col("l_discount").alias("b03"),
        (F.col("l_quantity") / 1000).alias("b04"), (F.col("l_extendedprice") / 1e6).alias("b8a"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"),
    )


ACQ = """acq AS (
  SELECT l_suppkey AS site, l_linestatus AS source, CAST(l_shipdate AS DATE) AS date, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS day,
    'S2A_MSIL2A_' || strftime(l_shipdate, '%Y%m%d') || '_REFL.tif' AS filename, l_tax AS b02, l_discount AS b03, l_quantity / 1000 AS b04, l_extendedprice / 1e6::DOUBLE AS b8a,
    l_orderkey * 100 + l_linenumber AS pos FROM lineitem)"""
NDVI = "CASE WHEN b04 > 0 AND b8a > 0 THEN (b8a - b04) / (b8a + b04) END"


def ser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one value per day and scenario (type)."""
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("scenario")).agg(F.avg("value").alias("value"), F.min("event_id").alias("pos"))


SER = "ser AS (SELECT CAST(ts AS DATE) AS date, event_type AS scenario, avg(value) AS value, min(event_id) AS pos FROM events GROUP BY 1, 2)"


def ser_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with several rows a day and scenario; those of user group 3 have a null value."""
    group = F.col("user_id") % 10
    rows = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("scenario"), group.alias("grp")).agg(F.avg("value").alias("value"), F.min("event_id").alias("pos"))
    return rows.withColumn("value", F.when(F.col("grp") != 3, F.col("value")))


SER_USER = """ser_user AS (SELECT date, scenario, grp, CASE WHEN grp <> 3 THEN value END AS value, pos FROM
  (SELECT CAST(ts AS DATE) AS date, event_type AS scenario, user_id % 10 AS grp, avg(value) AS value, min(event_id) AS pos FROM events GROUP BY 1, 2, 3))"""


def ser_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily values per priority over years, with natural gaps; the odd divisor avoids ties in rounding."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("scenario"))
    return rows.agg((F.avg("o_totalprice") / 499979).alias("value"), F.min("o_orderkey").alias("pos"))


SER_LONG = "ser_long AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS scenario, avg(o_totalprice) / 499979 AS value, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2)"


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scenes of 4 bands x 4 x 4 pixels; eight sites, one scene a day of the year each at most by turns."""
    tiles = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 366).cast("int")).alias("date"), (F.col("vec_id") % 8).alias("site"), "embedding")
    return raster.explode_tiles(tiles, ["scene", "site", "date"], "embedding", 4, 4)


PX = """px AS (
  SELECT vec_id AS scene, vec_id % 8 AS site, CAST(DATE '2024-01-01' + CAST(vec_id % 366 AS INT) AS DATE) AS date, CAST(p // 4 AS INT) AS row, CAST(p % 4 AS INT) AS col,
    CAST(embedding[p + 1] AS DOUBLE) AS b02, CAST(embedding[p + 17] AS DOUBLE) AS b03, CAST(embedding[p + 33] AS DOUBLE) AS b04, CAST(embedding[p + 49] AS DOUBLE) AS b8a
  FROM (SELECT vec_id, embedding, unnest(range(16)) AS p FROM embeddings))"""


def bright(pixels: DataFrame) -> DataFrame:
    """px moved to positive reflectances."""
    return pixels.select("scene", "site", "date", "row", "col", *[(F.col(b) + 0.6).alias(b) for b in raster.BANDS])


BRIGHT = "bright AS (SELECT scene, site, date, row, col, b02 + 0.6 AS b02, b03 + 0.6 AS b03, b04 + 0.6 AS b04, b8a + 0.6 AS b8a FROM px)"
