"""Withheld-acquisition experiments: the manifest of gaps, the masked input, and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import centred_window
from . import metrics, series, smoothing
from .phenology import midpoint

GAP_DAYS = (15, 30, 60, 90)


def manifest(sites: DataFrame, acquisitions: DataFrame, gaps: tuple[int, ...] = GAP_DAYS) -> DataFrame:
    """Per site, season and gap: midpoint, window, prediction day (the midpoint) and the acquisition withheld, the nearest to it.

    sites(site, season, green_up, green_down); acquisitions(site, date, filename). Without an acquisition within a year the
    withheld columns are null.
    """
    rule, mid = midpoint(F.col("green_up"), F.col("green_down"), F.col("season"))
    rows = sites.select("site", "season", rule.alias("midpoint_rule"), mid.alias("midpoint_date"))
    reach = rows.groupBy("site").agg(F.date_sub(F.min("midpoint_date"), 365).alias("_a"), F.date_add(F.max("midpoint_date"), 365).alias("_b"))
    near = acquisitions.join(reach, "site").filter(F.col("date").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # before anything is sorted
    held = series.nearest(rows.select("site", "season", "midpoint_date"), near, ["site"], ["site", "season"], "midpoint_date", 365)
    held = held.select("site", "season", F.col("nearest_day").alias("withheld_date"), F.col("nearest_name").alias("withheld_filename"))
    each = rows.withColumn("gap_days", F.explode(F.array(*[F.lit(g) for g in gaps])))
    start, end = centred_window(F.col("midpoint_date"), F.col("gap_days"), F.col("season"))
    out = each.withColumn("window_start", start).withColumn("window_end", end).withColumn("prediction_date", F.col("midpoint_date"))
    return out.join(held, ["site", "season"], "left")


def masked(acquisitions: DataFrame, entries: DataFrame, mask: str = "withheld_day") -> DataFrame:
    """Acquisitions of each entry without its withheld day, or with mask='window' without all days of its window."""
    each = acquisitions.join(entries.select("site", "season", "gap_days", "withheld_date", "window_start", "window_end"), "site")
    gone = F.col("date") == F.col("withheld_date") if mask == "withheld_day" else F.col("date").between(F.col("window_start"), F.col("window_end"))
    return each.filter(~F.coalesce(gone, F.lit(False))).drop("withheld_date", "window_start", "window_end")


def evaluate(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of the gap and the full prediction and of the constant mean field against truth, over pixels that all know, with their deltas.

    pixels(keys, row, col, truth, gap, nogap).
    """
    rows = pixels.filter("truth is not null and gap is not null and nogap is not null")
    t, g, n = F.col("truth"), F.col("gap"), F.col("nogap")
    enough = F.count("*") >= metrics.LEAST_PAIRS
    scores = {"rmse": metrics.rmse(g, t), "mae": metrics.mae(g, t), "mean_bias": F.avg(g - t), "pearson_r": metrics.pearson(g, t), "nse": metrics.efficiency(g, t), "rmse_nogap": metrics.rmse(n, t), "nse_nogap": metrics.efficiency(n, t)}
    # the error of a constant c is the variance of truth and its mean's distance to c
    scores["rmse_constant"] = F.sqrt(F.var_pop(t) + F.pow(F.avg(t) - F.avg(n), 2))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_pixels"), *[F.when(enough, c).alias(name) for name, c in scores.items()])
    return out.withColumn("delta_rmse", F.col("rmse") - F.col("rmse_nogap")).withColumn("delta_nse", F.col("nse_nogap") - F.col("nse"))


def baseline_without(rows: DataFrame, entries: DataFrame, keys: list[str], lam: float = smoothing.LAMBDA) -> DataFrame:
    """Per entry the smoothed series at its prediction day, the series without the withheld day; null outside it or with too few days.

    rows(keys, date, value, pos); entries(keys, gap_days, withheld_date, prediction_date). An entry without a withheld day has null.
    """
    wanted = entries.filter("withheld_date is not null")
    each = rows.join(wanted.select(*keys, "gap_days", "withheld_date"), keys).filter("date <> withheld_date")
    smooth = smoothing.whittaker(each.select(*keys, "gap_days", "date", "value", "pos"), [*keys, "gap_days"], lam=lam)
    found = smooth.withColumnRenamed("date", "prediction_date").withColumnRenamed("smoothed", "whittaker")
    return entries.join(found, [*keys, "gap_days", "prediction_date"], "left")


def results(entries: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Every entry with its scores, or with the reason why it has none."""
    why = F.when(F.col("withheld_date").isNull(), "no acquisition to withhold").when(F.col("n_pixels").isNull(), "no common pixels")
    return entries.join(scores, keys, "left").withColumn("error", why)
