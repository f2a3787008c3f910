"""Agreement of series and images with a truth: one aggregation, no second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAIRS = 2


def pearson(x: Column, y: Column) -> Column:
    """Null where either does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def efficiency(pred: Column, truth: Column) -> Column:
    """1 less squared error over squared deviation of truth; null where truth does not vary. Also r squared against the mean."""
    return 1 - F.try_divide(F.sum((truth - pred) * (truth - pred)), F.var_pop(truth) * F.count(truth))


def rmse(pred: Column, truth: Column) -> Column:
    return F.sqrt(F.avg((truth - pred) * (truth - pred)))


def mae(pred: Column, truth: Column) -> Column:
    return F.avg(F.abs(truth - pred))


def nrmse(pred: Column, truth: Column) -> Column:
    """By the mean of truth."""
    return F.try_divide(rmse(pred, truth), F.avg(truth))


def temporal_metrics(pairs: DataFrame, keys: list[str], day: str = "date") -> DataFrame:
    """The bundle for each key with at least two matched days: correlation, efficiency, errors, residuals (pred - truth), dates."""
    p, t = F.col("pred"), F.col("truth")
    nse = efficiency(p, t)
    out = pairs.groupBy(*keys).agg(
        pearson(p, t).alias("pearson_r"), nse.alias("r_squared"), rmse(p, t).alias("rmse"), mae(p, t).alias("mae"), nrmse(p, t).alias("nrmse"), nse.alias("nse"), nse.alias("nse_pc"),
        F.count("*").alias("n_samples"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.avg(p - t).alias("residual_mean"), F.stddev_pop(p - t).alias("residual_std"),
    )
    return out.filter(F.col("n_samples") >= LEAST_PAIRS)


def truth_stats(truth: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    rows = truth.filter(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n_samples"))


def spatial_scores(pixels: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", mask: Column | None = None) -> DataFrame:
    """n_pixels of the mask where both are known, and the scores where there are at least two."""
    p, t = F.col(pred), F.col(truth)
    valid = p.isNotNull() & t.isNotNull()
    rows = pixels.filter(valid & mask if mask is not None else valid)
    enough = F.count("*") >= LEAST_PAIRS
    scores = {"rmse": rmse(p, t), "mae": mae(p, t), "mean_bias": F.avg(p - t), "pearson_r": pearson(p, t), "nse": efficiency(p, t)}
    return rows.groupBy(*keys).agg(F.count("*").alias("n_pixels"), *[F.when(enough, c).alias(n) for n, c in scores.items()])


def derived(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys, strategy and mode: NSE at sigma 20 less NSE at sigma 30, null where either is missing; one row of a full grid each."""
    at = lambda s: F.max(F.when(F.col("sigma") == s, F.col("nse")))
    return metrics.groupBy(*keys, "strategy", "mode").agg((at(20) - at(30)).alias("delta_nse"))


def paired_residuals(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys, strategy and sigma: the mean residual of both modes side by side."""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("residual_mean")))
    return metrics.groupBy(*keys, "strategy", "sigma").agg(of("bti").alias("mean_residual_bti"), of("itb").alias("mean_residual_itb"))


def scenarios_of(rows: DataFrame) -> DataFrame:
    """Every row once for each strategy, sigma and mode, with the scenario's key as reports name it."""
    each = lambda name, *values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    grid = rows.select("*", each("strategy", "aggressive", "nonaggressive")).select("*", each("sigma", 20, 30)).select("*", each("mode", "bti", "itb"))
    return grid.withColumn("scenario", scenario_key(F.col("strategy"), F.col("sigma"), F.col("mode")))


def scenarios(spark) -> DataFrame:
    """The grid of strategies, sigmas and modes."""
    return scenarios_of(spark.range(1)).drop("id")


def scenario_key(strategy: Column, sigma: Column, mode: Column) -> Column:
    return F.concat(strategy, F.lit("_sigma"), sigma.cast("string"), F.when(mode == "itb", "_itb").otherwise(""))
