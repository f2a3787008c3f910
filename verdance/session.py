"""A session with the settings that the engine is written for; a cluster's own settings win."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "verdance", cpus: int | str = "*", **config: str) -> SparkSession:
    """Local by default. Adaptive execution sizes and splits partitions; time zone and ANSI mode are fixed for equal results."""
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER") and "spark.master" not in config:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g")
    return builder.config(map=settings | config).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the cluster shares; only a local session may do without one, and gets a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="verdance-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint what several others read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)
