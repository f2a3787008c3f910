"""Daily series: duplicate days, matching, merging, gap filling and nearest days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def dedupe(rows: DataFrame, keys: list[str], value: str, position: str, policy: str) -> DataFrame:
    """One value per key: the first or last by position, nulls included, or the first that is not null (first_valid)."""
    if policy == "first_valid":
        rows, policy = rows.filter(F.col(value).isNotNull()), "first"
    pick = {"first": F.min_by, "last": F.max_by}[policy]
    return rows.groupBy(*keys).agg(pick(value, position).alias(value))


def match_days(candidate: DataFrame, truth: DataFrame, keys: list[str], truth_keys: list[str], position: str = "pos", day: str = "date") -> DataFrame:
    """Days of both series with (pred, truth): the first row of a day wins, null or not, and days with a null on either side go."""
    a = dedupe(candidate, [*keys, day], "value", position, "first").withColumnRenamed("value", "pred")
    b = dedupe(truth, [*truth_keys, day], "value", position, "first").withColumnRenamed("value", "truth")
    return a.join(b, [*truth_keys, day]).filter(F.col("pred").isNotNull() & F.col("truth").isNotNull())


def export_merge(ndvi: DataFrame, gcc: DataFrame, bands: DataFrame, day: str = "date") -> DataFrame:
    """Full outer merge by day; a shared column comes from the later source that has the day."""
    a = ndvi.select(day, F.col("filename").alias("f1"), "ndvi")
    b = gcc.select(day, F.col("filename").alias("f2"), "greenness_index")
    c = bands.select(day, F.col("filename").alias("f3"), "b02", "b03", "b04", "b8a")
    out = a.join(b, day, "full").join(c, day, "full")
    return out.select(day, F.coalesce("f3", "f2", "f1").alias("filename"), "ndvi", "greenness_index", "b02", "b03", "b04", "b8a")


def day_grid(rows: DataFrame, keys: list[str], day: str = "date", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Every day of each key between the first and last day, or the given bounds."""
    bounds = rows.groupBy(*keys).agg((start if start is not None else F.min(day)).alias("_a"), (end if end is not None else F.max(day)).alias("_b"))
    return bounds.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))


def interpolate(rows: DataFrame, keys: list[str], value: str = "value", day: str = "date") -> DataFrame:
    """value at null days: linear between the neighbours, flat outside them; null where a key has no value."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(day)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(number.alias("d"), F.col(value).alias("v")))
    out = rows.withColumn("_p", F.last(known, True).over(before)).withColumn("_n", F.first(known, True).over(after))
    slope = F.try_divide(F.col("_n.v") - F.col("_p.v"), F.col("_n.d") - F.col("_p.d"))
    filled = F.coalesce(F.col(value), F.col("_p.v") + slope * (number - F.col("_p.d")), F.col("_p.v"), F.col("_n.v"))
    return out.withColumn("filled", filled).drop("_p", "_n")


def nearest(targets: DataFrame, acquisitions: DataFrame, keys: list[str], target_keys: list[str], target_day: str, most_days: int, day: str = "date", name: str = "filename") -> DataFrame:
    """For each target the acquisition of the nearest day within `most_days`; the earlier of equals, then the first by name.

    Targets and acquisitions of a key share one sort: the last acquisition up to a target and the first from it on are the only
    candidates, however dense the series and wide the reach.
    """
    others = [k for k in target_keys if k not in keys]
    number = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    t = targets.select(*keys, F.struct(*[F.col(k) for k in [*others, target_day]]).alias("_target"), number(F.col(target_day)).alias("_n")).distinct()
    a = acquisitions.groupBy(*keys, F.col(day).alias("_day")).agg(F.min(name).alias("_name"))
    a = a.select(*keys, F.struct(number(F.col("_day")).alias("n"), F.col("_day").alias("day"), F.col("_name").alias("name")).alias("_taken"), number(F.col("_day")).alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_n")
    both = t.unionByName(a, allowMissingColumns=True)
    both = both.withColumn("_p", F.last("_taken", True).over(line.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_f", F.first("_taken", True).over(line.rangeBetween(0, Window.unboundedFollowing)))
    near = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.n") - F.col("_n")).alias("_d"), F.col(f"{c}.day").alias("nearest_day"), F.col(f"{c}.name").alias("nearest_name"))) for c in ("_p", "_f")]
    best = F.when(F.col("_p").isNull(), near[1]).when(F.col("_f").isNull(), near[0]).otherwise(F.least(*near))
    found = both.filter("_target is not null").withColumn("_best", best).filter(F.col("_best._d") <= most_days)
    return found.select(*keys, *[F.col(f"_target.{k}").alias(k) for k in [*others, target_day]], "_best.nearest_day", "_best.nearest_name", F.col("_best._d").alias("distance"))


def nearest_in_season(targets: DataFrame, products: DataFrame, keys: list[str], kinds: list[str], target_day: str = "target", most_days: int = 365, day: str = "date", name: str = "filename") -> DataFrame:
    """For each target and kind of product the nearest one of its season, the earlier of equals: (keys, season, target, kind, nearest_day, nearest_name, distance).

    targets(keys, season, target) may repeat; products(keys, kind, date, filename) belong to the season of their year, so a search
    stops at the season's ends. All kinds share one sort. Targets without a product within `most_days` have no row for the kind.
    """
    wanted = targets.select(*keys, "season", target_day, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    of_season = products.select(*keys, F.year(day).alias("season"), "kind", day, name)
    found = nearest(wanted, of_season, [*keys, "season", "kind"], [*keys, "season", "kind"], target_day, most_days, day, name)
    return found.select(*keys, "season", target_day, "kind", "nearest_day", "nearest_name", "distance")


def day_counts(rows: DataFrame, keys: list[str], day: str = "date") -> DataFrame:
    """Acquisitions of each day."""
    return rows.groupBy(*keys, day).agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """rows in order over all partitions and within them, numbered from 0: what a listing sorted by day or by name is.

    One range sort; the rows before a partition are the sum of the sizes of those before it, one number a partition. The sorted
    rows are checkpointed, as ranges are sampled and must not be drawn twice.
    """
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = held.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_p", before.alias("_s")))  # one row a partition
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(starts, part == F.col("_p")).withColumn(name, F.col("_s") + place).drop("_m", "_p", "_s")


def increments(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows numbered from 0 within their keys."""
    return rows.withColumn("increment", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def precedence_merge(first: DataFrame, second: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Full outer merge in which the first table's value wins where it has one."""
    b = second.withColumnRenamed(value, "_second")
    return first.join(b, keys, "full").select(*keys, F.coalesce(value, "_second").alias(value))


def three_year_stack(rows: DataFrame, keys: list[str], season: Column, replicate: bool, value: str = "value", day: str = "date") -> DataFrame:
    """365 days for each of the years about the season, leap years' last day dropped: (keys, year, doy, value).

    With `replicate` the season's own year stands in for all three.
    """
    own = rows.withColumn("_season", season).withColumn("year", F.year(day)).withColumn("doy", F.dayofyear(day)).filter("doy <= 365")
    if replicate:
        own = own.filter("year = _season").withColumn("year", F.explode(F.array(*[F.col("_season") + k for k in (-1, 0, 1)])))
    return own.filter(F.abs(F.col("year") - F.col("_season")) <= 1).groupBy(*keys, "year", "doy").agg(F.max_by(value, day).alias(value))
