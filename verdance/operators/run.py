"""The products of a season's run as one graph: fused -> cropped -> series -> metrics, for all sites and scenarios at once.

Each product is made once and on demand. What several others read (the input stacks and the fused one) is checkpointed, so that
no table is read and no scene fused again for another product.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indices import gcc
from ..session import cut
from . import metrics, products, raster

STRATEGIES = products.STRATEGIES


def _no_index(bands: tuple[str, ...]) -> Column:
    return F.coalesce(F.greatest(*[F.col(b) for b in bands], F.col("greenness_index")) > raster.VALID, F.lit(False))


def cropped_scenarios(fused: DataFrame, keys: tuple[str, ...] = ("site",), bands: tuple[str, ...] = raster.BANDS) -> tuple[DataFrame, DataFrame]:
    """Fused scenes of all scenarios within their valid extent, and the extents; rows and columns stay those of the whole grid.

    fused(keys, row, col, date, scenario, bands, greenness_index). A scene without a valid pixel has none left.
    """
    scene = [*keys, "scenario", "date"]
    bounds = raster.extent(fused, scene, _no_index(bands))
    inside = F.col("row").between(F.col("row_0"), F.col("row_1")) & F.col("col").between(F.col("col_0"), F.col("col_1"))
    return fused.join(bounds, scene).filter(inside).drop("row_0", "row_1", "col_0", "col_1"), bounds


@dataclass(frozen=True, eq=False)
class Run:
    """fine(keys, row, col, date, bands, distance, excluded_<strategy>) and coarse(keys, row, col, date, bands) on the fusion grid,
    truth(keys, date, value, pos), and the site's pixel as columns of both stacks, or as constants."""

    fine: DataFrame
    coarse: DataFrame
    truth: DataFrame
    row: Column
    col: Column
    keys: tuple[str, ...] = ("site",)
    sigmas: tuple[int, ...] = (20, 30)
    bands: tuple[str, ...] = raster.BANDS

    @cached_property
    def stacks(self) -> tuple[DataFrame, DataFrame]:
        return cut(self.fine), cut(self.coarse)

    @cached_property
    def fused(self) -> DataFrame:
        return cut(products.fused_scenarios(*self.stacks, self.sigmas, self.keys, self.bands))

    @cached_property
    def _crop(self) -> tuple[DataFrame, DataFrame]:
        return cropped_scenarios(self.fused, self.keys, self.bands)

    @property
    def cropped(self) -> DataFrame:
        return self._crop[0]

    @cached_property
    def series(self) -> DataFrame:
        """Index, greenness and bands about the site, by scenario and day, from the cropped scenes."""
        return products.scenario_series(self.cropped, self.row, self.col, self.keys, self.bands)

    def _near(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col("row").between(self.row - 1, self.row + 1) & F.col("col").between(self.col - 1, self.col + 1))

    @cached_property
    def fine_series(self) -> DataFrame:
        """(keys, date, value, pos, excluded_<strategy>): the greenness of the site's mean bands on each fine day."""
        flags = [F.bool_or(f"excluded_{s}").alias(f"excluded_{s}") for s in STRATEGIES]
        means = products.site_means(self._near(self.stacks[0]), [*self.keys, "date"], self.bands, flags)
        return means.select(*self.keys, "date", gcc(F.col("b02"), F.col("b03"), F.col("b04")).alias("value"), F.lit(0).cast("long").alias("pos"), *[f"excluded_{s}" for s in STRATEGIES])

    @cached_property
    def coarse_series(self) -> DataFrame:
        """(keys, date, value, pos, baseline): the mean greenness of coarse pixels within each strategy's cropped scenes of the usual width."""
        named = F.create_map(*[x for s in STRATEGIES for x in (F.lit(f"{s}_sigma{self.sigmas[0]}"), F.lit(f"s3_{s}"))])
        bounds = self._crop[1].withColumn("baseline", named[F.col("scenario")]).filter("baseline is not null").drop("scenario")
        near = self._near(self.stacks[1]).join(bounds, [*self.keys, "date"])
        near = near.filter(F.col("row").between(F.col("row_0"), F.col("row_1")) & F.col("col").between(F.col("col_0"), F.col("col_1")))
        return near.groupBy(*self.keys, "date", "baseline").agg(F.avg(gcc(F.col("b02"), F.col("b03"), F.col("b04"))).alias("value")).withColumn("pos", F.lit(0).cast("long"))

    @cached_property
    def candidates(self) -> DataFrame:
        """(keys, section, name, date, value, pos) of all baselines and scenarios."""
        columns = [*self.keys, "section", "name", "date", "value", "pos"]
        base = products.baselines(self.fine_series, F.lit(True), list(self.keys)).unionByName(self.coarse_series)
        base = base.withColumn("section", F.lit("baseline")).withColumnRenamed("baseline", "name")
        fused = self.series.select(*self.keys, F.lit("temporal").alias("section"), F.col("scenario").alias("name"), "date", F.col("greenness_index").alias("value"), F.lit(0).cast("long").alias("pos"))
        return base.select(columns).unionByName(fused.select(columns))

    @cached_property
    def metrics(self) -> DataFrame:
        """The metrics of every baseline and scenario of a site, in one match with the truth and one aggregation."""
        named = self.candidates.withColumn("_k", F.struct("section", "name"))
        found = products.scored(named, self.truth, list(self.keys), "_k", list(self.keys))
        return found.select(*self.keys, "_k.section", "_k.name", *[c for c in found.columns if c not in (*self.keys, "_k")])

    @cached_property
    def document(self) -> DataFrame:
        """The metrics as one nested JSON text per site, a projection of the flat ones; sites without a truth have none."""
        keys, flat = list(self.keys), cut(self.metrics)
        part = lambda section, name: flat.filter(F.col("section") == section).drop("section").withColumnRenamed("name", name)
        temporal = part("temporal", "scenario").join(metrics.scenarios(flat.sparkSession), "scenario")
        stats = metrics.truth_stats(self.truth, keys)
        return products.metrics_document(part("baseline", "baseline"), temporal, stats, keys)
