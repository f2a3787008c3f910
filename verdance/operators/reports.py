"""Report tables over metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DASH = "—"


def scenario_table(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per scenario with the reported metrics as text; the point-wise efficiency falls back to the plain one."""
    shown = {"r_squared": "r_squared", "nrmse": "nrmse", "nse": F.coalesce("nse_pc", "nse"), "mean_residual": "residual_mean"}
    return metrics.select(*keys, *[F.coalesce(F.format_string("%.3f", F.round(c, 3)), F.lit(DASH)).alias(n) for n, c in shown.items()])


def pivot(metrics: DataFrame, keys: list[str], column: str, values: list, metric: str) -> DataFrame:
    """A metric side by side for the given values of a column; the values are stated, so no extra pass finds them."""
    return metrics.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == v, F.col(metric))).alias(f"{metric}_{v}") for v in values])


def baseline_order(rows: DataFrame, column: str = "baseline") -> DataFrame:
    """Rows in report order: the raw fine series, then per strategy the coarse, cloud-free and smoothed ones."""
    order = F.when(F.col(column) == "s2", 0).when(F.col(column).startswith("s3"), 1).when(F.col(column).startswith("s2_cloudfree"), 2).otherwise(3)
    return rows.withColumn("order_key", order)


def plotted(rows: DataFrame, keys: list[str], value: str, current: Column, width: float, height: float, pad: float = 30.0, day: str = "date") -> DataFrame:
    """Points of a series in the plot's coordinates, the ranges shown at its axis, and the point nearest the current day marked.

    x grows with the day, y falls with the value; a range without extent counts as 1. Days without a value have no point; of two
    days as near, the earlier is marked.
    """
    points = rows.filter(F.col(value).isNotNull())
    away = F.abs(F.datediff(F.col(day), current))
    ranges = points.groupBy(*keys).agg(F.min(day).alias("_d0"), F.max(day).alias("_d1"), F.min(value).alias("low"), F.max(value).alias("high"), F.min_by(day, F.struct(away, F.col(day))).alias("_near"))
    days, span = F.datediff("_d1", "_d0"), F.col("high") - F.col("low")
    x = pad + F.datediff(day, "_d0") / F.when(days == 0, 1).otherwise(days) * (width - 2 * pad)
    y = height - pad - (F.col(value) - F.col("low")) / F.when(span == 0, 1.0).otherwise(span) * (height - 2 * pad)
    marked = F.col(day) == F.col("_near")
    return points.join(ranges, keys).select(*keys, day, value, x.alias("x"), y.alias("y"), "low", "high", marked.alias("marked"))
