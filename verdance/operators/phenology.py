"""Start and end of season from a daily profile: local quadratic smoothing, then where it crosses half its amplitude."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFF = 0.5
#: Days of a year in a stack, and by how many standard deviations a spike leaves the range of its neighbours.
YEAR, SPIKE = 365, 2.0
#: Five-point quadratic smoothing weights over 35 (fixed values).
KERNEL = (-3, 12, 17, 12, -3)


def smooth(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """`fitted`: the five-point local quadratic, renormalised where the ends or nulls leave fewer points."""
    w = Window.partitionBy(*keys).orderBy(order)
    points = [F.lag(value, -k).over(w) if k > 0 else F.lag(value, abs(k)).over(w) if k < 0 else F.col(value) for k in range(-2, 3)]
    total = sum((F.coalesce(p, F.lit(0.0)) * c for p, c in zip(points, KERNEL, strict=True)), F.lit(0.0))
    used = sum((F.when(p.isNotNull(), c).otherwise(0) for p, c in zip(points, KERNEL, strict=True)), F.lit(0))
    return rows.withColumn("fitted", F.try_divide(total, F.nullif(used, F.lit(0)).cast("double")))


def season(rows: DataFrame, keys: list[str], day: str = "day", value: str = "value", cutoff: float = CUTOFF) -> DataFrame:
    """Per key: base (mean of the least fitted values before and after the peak), peak, threshold and the days of start and end.

    The start is the first upward crossing of the threshold at or before the peak, the end the last downward one at or after it,
    linear between days; null where the profile does not cross. The earliest of equal peaks counts. All steps are windows over a
    key, which share one exchange; the last aggregation needs none.
    """
    key, line = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(day)
    out = smooth(rows, keys, day, value)
    out = out.withColumn("_before", F.lag("fitted").over(line)).withColumn("_day", F.lag(day).over(line))
    out = out.withColumn("peak", F.max("fitted").over(key)).withColumn("peak_day", F.min_by(day, F.struct(-F.col("fitted"), F.col(day))).over(key))
    left, right = F.col(day) <= F.col("peak_day"), F.col(day) >= F.col("peak_day")
    out = out.withColumn("_l", F.min(F.when(left, F.col("fitted"))).over(key)).withColumn("_r", F.min(F.when(right, F.col("fitted"))).over(key))
    out = out.withColumn("base", (F.col("_l") + F.col("_r")) / 2).withColumn("threshold", F.col("base") + cutoff * (F.col("peak") - F.col("base")))
    t = F.col("threshold")
    at = F.col("_day") + F.try_divide(t - F.col("_before"), F.col("fitted") - F.col("_before")) * (F.col(day) - F.col("_day"))
    up = F.when((F.col("_before") < t) & (F.col("fitted") >= t) & left, at)
    down = F.when((F.col("_before") >= t) & (F.col("fitted") < t) & (F.col("_day") >= F.col("peak_day")), at)
    return out.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("base", "peak", "peak_day", "threshold")], F.min(up).alias("start"), F.max(down).alias("end"))


def midpoint(green_up: Column, green_down: Column, year: Column) -> tuple[Column, Column]:
    """(rule, day): green-up if it lies in the season, else green-down if it does, else 1 July."""
    up, down = (F.when(F.year(d) == year, d) for d in (green_up, green_down))
    rule = F.when(up.isNotNull(), "green_up").when(down.isNotNull(), "green_down").otherwise("mid_season")
    return rule, F.coalesce(up, down, F.make_date(year, F.lit(7), F.lit(1)))


# -- seasons on a stack of three years


def season_of_three_years(rows: DataFrame, keys: list[str], value: str = "value", day: str = "date", position: str | None = None, cutoff: float = CUTOFF, spike: float = SPIKE) -> DataFrame:
    """(keys, season, stack, peak, peak_day, green_up, green_up_value, green_down, green_down_value, fitted_max) for each year with a value.

    The year before, the season's own and the year after are filled to daily profiles (linear between known days, flat outside)
    of 365 days each and stacked; where one of them has no value, the season's own stands in for all (`stack` tells). Values count
    if finite and above 0, the last of a day by `position` if one is named; an observation more than `spike` standard deviations
    of its year outside the range of the two before and the two after it does not. The stack holds a cycle a year, each with its
    peak; the middle one is the season. Its base to the left is the least fitted value since the peak before, to the right that
    up to the next one. Green-up is where the fit first rises above `cutoff` of the way from the left base to the peak, green-down
    where it last falls below that of the right one; null where it doesn't. A site's year is an array, which goes to the three
    seasons that need it: two exchanges, the second of arrays.
    """
    number = F.col(value).cast("double")
    known = rows.filter(number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf")))
    item = F.struct(F.dayofyear(day).alias("d"), (F.col(position) if position else F.lit(0)).alias("p"), number.alias("v"))
    years = known.groupBy(*keys, F.year(day).alias("_y")).agg(F.sort_array(F.collect_list(item)).alias("_l"))
    part = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_part")
    each = years.select(*keys, (F.col("_y")).alias("_of"), "_l", part).select(*keys, (F.col("_of") + 1 - F.col("_part")).alias("season"), F.struct("_part", F.transform("_l", lambda x: x["d"]).alias("d"), F.transform("_l", lambda x: x["v"]).alias("v")).alias("_i"))
    stacks = each.groupBy(*keys, "season").agg(F.collect_list("_i").alias("_s")).filter(F.exists("_s", lambda x: x["_part"] == 1))
    kinds = [f"{k} {stacks.schema[k].dataType.simpleString()}" for k in keys]
    found = "stack string, peak double, peak_day date, green_up date, green_up_value double, green_down date, green_down_value double, fitted_max double"
    return stacks.mapInArrow(_seasons(len(keys), cutoff, spike), ", ".join([*kinds, "season int", found]))


def _filled(days: np.ndarray, values: np.ndarray, length: int, spike: float) -> np.ndarray:
    """A year's daily profile from its observations, in order of day; the last of a day counts."""
    last = np.append(days[1:] != days[:-1], True)
    days, values = days[last], values[last]
    if len(values) > 2:
        out = np.full((4, len(values)), np.nan)
        for k, shift in enumerate((1, 2)):
            out[k, shift:], out[k + 2, :-shift] = values[:-shift], values[shift:]
        far = spike * values.std()
        odd = (values > np.nanmax(out, 0) + far) | (values < np.nanmin(out, 0) - far)
        days, values = days[~odd], values[~odd]
    return np.interp(np.arange(1, length + 1), days, values)[:YEAR]


def crossings(fitted: np.ndarray, cutoff: float) -> dict[str, np.ndarray]:
    """Of stacks (rows of three years): places of peak, start and end in days from 0, and their values; nan where there is none."""
    m, n = fitted.shape
    at, rows = np.arange(n)[None, :], np.arange(m)
    before, peak, after = (fitted[:, k * YEAR : (k + 1) * YEAR].argmax(1) + k * YEAR for k in range(3))
    left = np.where((at >= before[:, None]) & (at <= peak[:, None]), fitted, np.inf)
    right = np.where((at >= peak[:, None]) & (at <= after[:, None]), fitted, np.inf)
    low, high = n - 1 - left[:, ::-1].argmin(1), right.argmin(1)  # the last lowest day before the peak, the first after it
    top = fitted[rows, peak]
    t_left = fitted[rows, low] + cutoff * (top - fitted[rows, low])
    t_right = fitted[rows, high] + cutoff * (top - fitted[rows, high])
    a, b, day = fitted[:, :-1], fitted[:, 1:], at[:, 1:]
    up = (a < t_left[:, None]) & (b >= t_left[:, None]) & (day > low[:, None]) & (day <= peak[:, None])
    down = (a >= t_right[:, None]) & (b < t_right[:, None]) & (day - 1 >= peak[:, None]) & (day <= high[:, None])
    first, final = up.argmax(1), n - 2 - down[:, ::-1].argmax(1)

    def place(k: np.ndarray, some: np.ndarray, t: np.ndarray) -> np.ndarray:
        f0, f1 = a[rows, k], b[rows, k]
        return np.where(some.any(1), k + np.divide(t - f0, f1 - f0, out=np.zeros(m), where=f1 != f0), np.nan)

    return {"peak": peak.astype(float), "top": top, "start": place(first, up, t_left), "t_left": t_left, "end": place(final, down, t_right), "t_right": t_right}


def _seasons(n_keys: int, cutoff: float, spike: float):
    kernel = np.array(KERNEL, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            years, stack, kind = b.column(n_keys).to_pylist(), np.empty((b.num_rows, 3 * YEAR)), []
            for k, parts in enumerate(b.column(n_keys + 1).to_pylist()):
                held = {p["_part"]: p for p in parts}
                kind.append("three_independent_years" if len(held) == 3 else "single_year_replicated")
                for part in range(3):
                    own = part if len(held) == 3 else 1
                    length = 366 if _leap(years[k] - 1 + own) else 365
                    stack[k, part * YEAR : (part + 1) * YEAR] = _filled(np.array(held[own]["d"]), np.array(held[own]["v"]), length, spike)
            padded = np.pad(stack, ((0, 0), (2, 2)))
            inside = np.pad(np.ones(3 * YEAR), 2)
            fitted = sum(c * padded[:, k : k + 3 * YEAR] for k, c in enumerate(kernel)) / sum(c * inside[k : k + 3 * YEAR] for k, c in enumerate(kernel))
            found = crossings(fitted, cutoff)
            first = np.array([f"{y - 1}-01-01" for y in years], "datetime64[D]")

            def dates(places: np.ndarray, years=years, first=first) -> pa.Array:
                """Days of a stack skip the last day of leap years."""
                gone, none = np.isnan(places), np.array([[_leap(y - 1), _leap(y)] for y in years], bool).reshape(-1, 2)
                day = np.where(gone, 0, np.floor(np.nan_to_num(places) + 0.5)).astype(int)
                day += (none[:, 0] & (day >= YEAR)).astype(int) + (none[:, 1] & (day >= 2 * YEAR)).astype(int)
                return pa.array((first + day).astype("datetime64[D]"), pa.date32(), mask=gone)

            def number(x: np.ndarray, at: np.ndarray | None = None) -> pa.Array:
                return pa.array(x, pa.float64(), mask=np.isnan(at) if at is not None else None)

            columns = [pa.array(kind), number(found["top"]), dates(found["peak"]), dates(found["start"]), number(found["t_left"], found["start"]), dates(found["end"]), number(found["t_right"], found["end"]), number(fitted.max(1, initial=-np.inf))]
            names = ["stack", "peak", "peak_day", "green_up", "green_up_value", "green_down", "green_down_value", "fitted_max"]
            yield pa.RecordBatch.from_arrays([*b.columns[: n_keys + 1], *columns], names=[*b.schema.names[: n_keys + 1], *names])

    return run


def _leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
