"""End-to-end products: prepared fine and coarse stacks, cropped triples, and the metrics of a site with all its baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indices import gcc, gcc_rgr, gcc_strict, ndvi, nodata_to_null, positive, reflectance
from ..session import cut
from ..sinks.versions import Store
from . import fusion, gap, metrics, phenology, raster, screening, series, smoothing, warp

STRATEGIES = tuple(screening.STRATEGIES)


def day_scenes(scenes: DataFrame, excluded: DataFrame | None, keys: tuple[str, ...] = ("site", "date")) -> DataFrame:
    """(keys, filename) of the first scene by name of each day that screening keeps. Only names are read, not pixels."""
    kept = screening.without(scenes.select(*keys, "filename"), excluded, ["filename"])
    return kept.groupBy(*keys).agg(F.min("filename").alias("filename"))


def prepare_fine(tiles: DataFrame, excluded: DataFrame | None, grids: DataFrame, coarse: DataFrame, ratio: int, keys: tuple[str, ...] = ("site", "date"), bands: tuple[str, ...] = raster.BANDS, array: str = "bands") -> DataFrame:
    """Fine scenes ready for fusion: the day's scene chosen, reflectances warped to the coarse bounds, and the distance to clouds of their coarse cell.

    tiles(keys, filename, array) hold digital numbers, one band after another, row by row, on their site's grid; grids and coarse
    are those grids and the coarse ones (see warp), by all keys but the day. The result is on the coarse bounds, `ratio` times as
    fine. A coarse cell is clear where all its fine pixels hold a value, so cells beyond the scene are not. Distances are in
    coarse cells; null where a scene has no cloud. The names chosen and the warped pixels are checkpointed, as two parts read them.
    """
    place, scene = list(keys[:-1]), [*keys, "filename"]
    names = cut(day_scenes(tiles, excluded, keys))
    chosen = tiles.join(names, scene, "left_semi").join(grids.select(*place, "height", "width"), place)
    pixels = raster.explode_tiles(chosen, scene, array, F.col("width"), F.col("height"), bands)
    target = warp.refined(coarse, ratio)
    read = cut(warp.warp(pixels.select(*scene, "row", "col", *[reflectance(F.col(b)).alias(b) for b in bands]), grids, target, place, scene, list(bands)))
    cell = [F.floor(F.col(c) / ratio).cast("int") for c in ("row", "col")]
    seen = read.groupBy(*scene, cell[0].alias("row"), cell[1].alias("col")).agg(F.count_if(raster.valid(bands)).alias("_n"))
    every = names.join(coarse.select(*place, "height", "width"), place)
    every = every.select(*scene, F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"), "width").select(*scene, "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    clear = every.join(seen, [*scene, "row", "col"], "left").select(*scene, "row", "col", (F.coalesce("_n", F.lit(0)) == ratio * ratio).alias("clear"))
    found = raster.rescale_distance(raster.cloud_distance(clear, scene, "clear"), scene)
    found = found.select(*scene, F.col("row").alias("_r"), F.col("col").alias("_c"), "distance")
    return read.withColumn("_r", cell[0]).withColumn("_c", cell[1]).join(found, [*scene, "_r", "_c"]).drop("_r", "_c")


def truth_on_grid(pixels: DataFrame, grids: DataFrame, target: DataFrame, keys: list[str], scene: list[str]) -> DataFrame:
    """The strict greenness of fine scenes on another grid, as spatial scores compare it: blue, green and red are warped, then divided."""
    out = warp.warp(pixels, grids, target, keys, scene, ["b02", "b03", "b04"])
    return out.select(*scene, "row", "col", gcc_strict(F.col("b02"), F.col("b03"), F.col("b04")).alias("truth"))


def prepare_coarse(pixels: DataFrame, excluded: DataFrame | None, size: tuple[int, int], target: tuple[int, int], keys: tuple[str, ...] = ("site", "date"), bands: tuple[str, ...] = raster.BANDS, width: int = 5) -> DataFrame:
    """Coarse scenes ready for fusion: screened, composited by day, brought to the target grid by a cubic kernel, and averaged over composites.

    pixels(keys, filename, row, col, bands); `keys` ends with the day.
    """
    kept = screening.without(pixels, excluded, ["filename"])
    daily = raster.composite(kept, list(keys), bands, "filename")
    out = raster.resample_to(daily, list(keys), size, target, list(bands), "cubic")
    for b in bands:
        out = smoothing.moving_average(out, [*keys[:-1], "row", "col"], keys[-1], b, width).drop(b).withColumnRenamed("smoothed", b)
    return out


def grow_fine(store: Store, tiles: DataFrame, excluded: DataFrame | None, grids: DataFrame, coarse: DataFrame, ratio: int, keys: tuple[str, ...] = ("site", "date"), bands: tuple[str, ...] = raster.BANDS, array: str = "bands") -> int:
    """Prepare what `store` (of prepare_fine's rows, by keys and filename) doesn't hold yet, and commit it; returns how many scenes that were.

    A day whose first scene is another one now gets that scene as well; `day_scenes` tells which scene of a day counts.
    """
    seen = store.version
    new = cut(store.unseen(day_scenes(tiles, excluded, keys)))
    n = new.count()
    if n:
        rows = tiles.join(new, [*keys, "filename"], "left_semi")
        store.commit(prepare_fine(rows, None, grids, coarse, ratio, keys, bands, array), new, seen)
    return n


def grow_coarse(composites: Store, smoothed: Store, pixels: DataFrame, excluded: DataFrame | None, size: tuple[int, int], target: tuple[int, int], keys: tuple[str, ...] = ("site", "date"), bands: tuple[str, ...] = raster.BANDS, width: int = 5) -> tuple[int, int]:
    """Bring both stores, of a site's composites by day and of their moving averages, up to pixels(keys, filename, row, col, bands).

    A day is composited again if its scenes are not the ones it was made of. Averages count composites, not days, so those of the
    width // 2 composites to either side of a new one are made again, and no others. Returns (days composited, days averaged).
    """
    kept = screening.without(pixels, excluded, ["filename"])
    made_of = F.sha2(F.array_join(F.sort_array(F.collect_set("filename")), "\n"), 256).alias("made_of")
    now = kept.select(*keys, "filename").distinct().groupBy(*keys).agg(made_of)
    seen = composites.version
    held = composites.read().select(*keys, "made_of").distinct() if seen else None
    new = cut(now if held is None else now.join(held, [*keys, "made_of"], "left_anti"))
    n = new.count()
    if not n:
        return 0, 0
    daily = raster.composite(kept.join(new, list(keys), "left_semi"), list(keys), bands, "filename")
    made = raster.resample_to(daily, list(keys), size, target, list(bands), "cubic").join(new, list(keys))
    composites.commit(made, after=seen)
    every, half = composites.read(), width // 2
    place, day = list(keys[:-1]), keys[-1]
    near = Window.partitionBy(*place).orderBy(day)
    days = every.select(*keys).distinct().join(new.select(*keys, F.lit(1).alias("_new")), list(keys), "left")
    redo = F.max("_new").over(near.rowsBetween(-half, half)) == 1
    days = days.withColumn("_redo", redo).withColumn("_read", F.max("_new").over(near.rowsBetween(-2 * half, 2 * half)) == 1).filter("_read").select(*keys, F.coalesce("_redo", F.lit(False)).alias("_redo"))
    days = cut(days)
    out = every.drop("made_of").join(days, list(keys))
    for b in bands:
        out = smoothing.moving_average(out, [*place, "row", "col"], day, b, width).drop(b).withColumnRenamed("smoothed", b)
    smoothed.commit(out.filter("_redo").drop("_redo"))
    return n, days.filter("_redo").count()


def cropped(fused: DataFrame, fine: DataFrame, coarse: DataFrame, ratio: int, is_valid: Column, scene: tuple[str, ...] = ("site", "date")) -> DataFrame:
    """Fused scenes cut to their valid extent, with the fine and coarse values of their pixels where those have the day.

    fused and fine(scene, row, col, value) share a grid, coarse(scene, row, col, value) is `ratio` times as coarse and is taken
    by its nearest cell.
    """
    keys = list(scene)
    bounds = raster.extent(fused, keys, is_valid)
    rows = fused.withColumnRenamed("value", "fused").join(fine.withColumnRenamed("value", "fine"), [*keys, "row", "col"], "left")
    near = raster.resample_nearest(coarse, keys, ratio, ["value"]).withColumnRenamed("value", "coarse")
    return raster.crop(rows.join(near, [*keys, "row", "col"], "left"), keys, bounds)


def baselines(flagged: DataFrame, fine: Column, keys: list[str], smooth: bool = True) -> DataFrame:
    """Series that fusion is compared with, labelled by `baseline`: all fine days, the cloud-free ones and their smoothed form, and the coarse ones by strategy.

    flagged(keys, date, value, pos, excluded_<strategy>) holds both sources; `fine` tells them apart. A row goes to all its
    series at once, so the table is read once, and again for the smoother only.
    """
    name = lambda s, kind: F.when(fine & ~F.col(f"excluded_{s}"), f"s2_cloudfree_{s}") if kind else F.when(~fine & ~F.col(f"excluded_{s}"), f"s3_{s}")
    labels = F.array_compact(F.array(F.when(fine, "s2"), *[name(s, kind) for s in STRATEGIES for kind in (True, False)]))
    out = flagged.select(*keys, "date", "value", "pos", F.explode(labels).alias("baseline"))
    if not smooth:
        return out
    kept = out.filter(F.col("baseline").startswith("s2_cloudfree")).withColumn("baseline", F.replace("baseline", F.lit("cloudfree"), F.lit("whittaker")))
    smoothed = smoothing.whittaker(kept, [*keys, "baseline"]).withColumnRenamed("smoothed", "value").withColumn("pos", F.lit(0).cast("long"))
    return out.unionByName(smoothed.select(out.columns))


def scored(candidates: DataFrame, truth: DataFrame, keys: list[str], label: str, truth_keys: list[str] | None = None) -> DataFrame:
    """The metrics of each labelled series against the truth of the same days."""
    return metrics.temporal_metrics(series.match_days(candidates, truth, [*keys, label], truth_keys or []), [*keys, label])


def metrics_document(baseline: DataFrame, temporal: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text per key: temporal (by scenario), derived, ground-truth statistics and baseline; parts without rows are left out.

    baseline(keys, baseline, metrics), temporal(keys, scenario, strategy, sigma, mode, metrics), stats(keys, ...).
    """

    def part(rows: DataFrame, label: str, name: str, dropped: tuple[str, ...] = ()) -> DataFrame:
        bundle = F.struct(*[F.col(c).alias(c) for c in rows.columns if c not in (*keys, label, *dropped)])
        return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label).alias("key"), bundle.alias("value"))))).alias(name))

    differences = metrics.derived(temporal, keys).filter("delta_nse is not null").withColumn("name", F.concat_ws("_", "strategy", "mode"))
    out = part(temporal, "scenario", "temporal", ("strategy", "sigma", "mode"))
    out = out.join(part(baseline, "baseline", "baseline"), keys, "full").join(part(differences, "name", "derived", ("strategy", "mode")), keys, "left")
    stats = stats.select(*keys, F.struct(*[c for c in stats.columns if c not in keys]).alias("ground_truth_stats"))
    return out.join(stats, keys, "inner").select(*keys, F.to_json(F.struct("temporal", "derived", "ground_truth_stats", "baseline")).alias("document"))


def phenology_of_site_seasons(site_seasons: DataFrame, truth: DataFrame) -> DataFrame:
    """All site-seasons with the start and end of their season from ground truth, null where it does not tell; truth(site, date, value)."""
    days = truth.withColumn("season", F.year("date")).groupBy("site", "season", F.dayofyear("date").alias("day")).agg(F.avg("value").alias("value"))
    found = phenology.season(days, ["site", "season"])
    date = lambda c: F.date_add(F.make_date(F.col("season"), F.lit(1), F.lit(1)), F.round(F.col(c)).cast("int") - 1)
    dates = found.select("site", "season", date("start").alias("green_up"), date("end").alias("green_down"))
    return site_seasons.select("site", "season").distinct().join(dates, ["site", "season"], "left")


def phenology_of_three_years(site_seasons: DataFrame, truth: DataFrame, position: str | None = None) -> DataFrame:
    """The same on a stack of three years (see phenology.season_of_three_years), with the fitted values and what the stack was."""
    found = phenology.season_of_three_years(truth, ["site"], position=position)
    return site_seasons.select("site", "season").distinct().join(found, ["site", "season"], "left")


def site_means(near: DataFrame, scene: list[str], bands: tuple[str, ...] = raster.BANDS, more: list[Column] | None = None) -> DataFrame:
    """Means of the bands over the pixels where the index is valid, one row a scene."""
    valid = positive(F.col("b04")) & positive(F.col("b8a"))
    return near.groupBy(*scene).agg(*[F.avg(F.when(valid, F.col(b))).alias(b) for b in bands], *(more or []))


def site_bands(pixels: DataFrame, scene: list[str], row: Column, col: Column) -> DataFrame:
    """Per scene of a stack the 3 x 3 sample of NDVI, greenness and bands about the site: one pass for all three series."""
    near = pixels.filter(F.col("row").between(row - 1, row + 1) & F.col("col").between(col - 1, col + 1))
    index = F.avg(ndvi(F.col("b04"), F.col("b8a"))).alias("ndvi"), F.avg(gcc(F.col("b02"), F.col("b03"), F.col("b04"))).alias("greenness_index")
    return site_means(near, scene, more=list(index)).select(*scene, "ndvi", "greenness_index", *raster.BANDS)


def fused_scenarios(fine: DataFrame, coarse: DataFrame, sigmas: tuple[int, ...] = (20, 30), keys: tuple[str, ...] = ("site",), bands: tuple[str, ...] = raster.BANDS, index: Callable[[Column, Column], Column] = gcc_rgr) -> DataFrame:
    """Fusion by every scenario in one plan: strategies, widths, and bands or the greenness index first.

    fine(keys, row, col, date, bands, distance, excluded_<strategy>), coarse(keys, row, col, date, bands) on the same grid. The
    index is a layer beside the bands and the strategies are runs, so pixels are shuffled once for all scenarios. `index` is that
    of the index-first mode, of green and red; its nodata of 0 counts as missing. With bands first, the greenness is that of the
    fused bands. Bands are null with the index first. Days are those of the coarse scenes.
    """
    first = nodata_to_null(index(F.col("b03"), F.col("b04")))
    cell, layers = [*keys, "row", "col", "date"], [*bands, "index"]
    targets = coarse.select(*keys, "date").distinct().withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in sigmas])))
    runs = {s: ~F.col(f"excluded_{s}") for s in STRATEGIES}
    fused = fusion.fuse_layers(fine.withColumn("index", first), coarse.select(*cell, *bands, first.alias("index")), targets, list(keys), layers, runs)
    none = lambda c: F.lit(None).cast("double").alias(c)
    whole = F.struct(F.lit("bti").alias("mode"), *[F.col(b).alias(b) for b in bands], gcc(F.col("b02"), F.col("b03"), F.col("b04")).alias("greenness_index"))
    alone = F.struct(F.lit("itb").alias("mode"), *[none(b) for b in bands], F.col("index").alias("greenness_index"))
    some = F.greatest(*[F.col(f"n_{b}") for b in bands]) > 0
    each = fused.withColumn("_s", F.explode(F.array_compact(F.array(F.when(some, whole), F.when(F.col("n_index") > 0, alone)))))
    scenario = metrics.scenario_key(F.col("run"), F.col("sigma"), F.col("_s.mode"))
    return each.select(*cell, scenario.alias("scenario"), *[F.col(f"_s.{b}").alias(b) for b in bands], F.col("_s.greenness_index").alias("greenness_index"))


def scenario_series(fused: DataFrame, row: Column, col: Column, keys: tuple[str, ...] = ("site",), bands: tuple[str, ...] = raster.BANDS) -> DataFrame:
    """The 3 x 3 sample about the site of every scenario and day, as one export table: index, greenness and bands."""
    near = fused.filter(F.col("row").between(row - 1, row + 1) & F.col("col").between(col - 1, col + 1))
    valid = positive(F.col("b04")) & positive(F.col("b8a"))
    means = [F.avg(F.when(valid, F.col(b))).alias(b) for b in bands]
    return near.groupBy(*keys, "scenario", "date").agg(F.avg(ndvi(F.col("b04"), F.col("b8a"))).alias("ndvi"), F.avg("greenness_index").alias("greenness_index"), *means)


def gap_experiment(entries: DataFrame, fine: DataFrame, coarse: DataFrame, sigma: int = 20, mask: str = "withheld_day", truth: DataFrame | None = None) -> DataFrame:
    """Every entry of a manifest with the scores of fusing its prediction day without its withheld acquisition, and with it.

    entries as of gap.manifest; fine(site, row, col, date, value, distance) and coarse(site, row, col, date, value) on one grid.
    Truth is the withheld acquisition, or where given truth(site, row, col, date, truth), as truth_on_grid makes it of scenes on a
    grid of their own. Only days in reach of a prediction meet its entry. Entries without scores tell why.
    """
    keys, entries = ["site", "season", "gap_days"], cut(entries)  # small, and read by every part
    wanted = entries.filter("withheld_date is not null").select(*keys, "withheld_date", "window_start", "window_end", "prediction_date")
    near = F.abs(F.datediff("date", "prediction_date")) <= fusion.MAX_DAYS
    full = fine.join(wanted, "site").filter(near)
    gone = F.col("date") == F.col("withheld_date") if mask == "withheld_day" else F.col("date").between(F.col("window_start"), F.col("window_end"))
    low = coarse.join(wanted, "site").filter(near).select(*keys, "row", "col", "date", "value")
    targets = wanted.select(*keys, F.col("prediction_date").alias("date"), F.lit(sigma).alias("sigma"))
    fused = fusion.fuse_layers(full.withColumn("_gone", gone), low, targets, keys, ["value"], {"gap": ~F.col("_gone"), "nogap": F.lit(True)})
    pair = fused.groupBy(*keys, "row", "col").agg(*[F.max(F.when(F.col("run") == r, F.col("value"))).alias(r) for r in ("gap", "nogap")])
    truth = fine.withColumn("truth", F.col("value")) if truth is None else truth
    truth = truth.join(wanted.select(*keys, F.col("withheld_date").alias("date")), ["site", "date"]).select(*keys, "row", "col", "truth")
    return gap.results(entries, gap.evaluate(pair.join(truth, [*keys, "row", "col"]), keys), keys)
