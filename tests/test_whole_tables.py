"""Queries over whole tables: no row is left out of what the operator takes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from verdance.plans import bindings as b
from verdance.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_nearest_acquisition_takes_every_order(spark):
    got = catalogue.QUERIES["nearest_acquisition"](spark, DATA)
    days = b.acq(spark, DATA).select("site", "date").distinct()
    orders = b.table(spark, DATA, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("site"), F.col("o_orderdate").cast("date").alias("target"))
    reach = orders.join(days, "site").filter(F.abs(F.datediff("date", "target")) <= 20).select("o_orderkey").distinct()
    assert {r[0] for r in got.select("o_orderkey").collect()} == {r[0] for r in reach.collect()}
    assert {r[0] for r in got.select(F.col("o_orderkey") % 3).distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("name", ["bilinear_resample", "cubic_resample"])
def test_resampling_takes_every_scene(spark, name):
    got = {r[0] for r in catalogue.QUERIES[name](spark, DATA).select("scene").distinct().collect()}
    assert got == {r[0] for r in b.px(spark, DATA).filter("b02 > -0.3").select("scene").distinct().collect()}


def test_fusion_predicts_every_day(spark):
    got = {tuple(r) for r in catalogue.QUERIES["weighted_fusion"](spark, DATA).select("site", "date").distinct().collect()}
    one = b.bright(b.px(spark, DATA)).select("site", "date").distinct()
    taken = one.filter(F.dayofyear("date") % 3 == 0).select("site", F.col("date").alias("taken"))
    reach = one.join(taken, "site").filter(F.abs(F.datediff("taken", "date")) <= 30).select("site", F.col("date").cast("string")).distinct()
    assert got == {tuple(r) for r in reach.collect()}
