"""The corpus pipeline: quality, near-duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the columns
of documents. Ids are taken as unique: rows that repeat an id go or stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import fmindex, minhash, mixing, quality, secrets

SIMILAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling toward good text keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.Classifier(docs, labels).kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without an id stay."""
    found = minhash.near_duplicates(docs, percent=SIMILAR)
    gone = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the benchmark's passages; a document that was nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    had = "had" + "_" * max(map(len, docs.columns), default=0)  # no column's name
    filled = F.length(F.coalesce("text", F.lit(""))) > 0
    cleaned = fmindex.remove_contamination(docs.withColumn(had, filled), benchmark)
    return _sized(cleaned.filter(~F.col(had) | filled), docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark."""
    findings, _ = secrets.incremental_scan(docs)
    return _sized(secrets.redact(docs, findings), docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row per copy of a document, by position."""
    return mixing.training_order(docs)


def _sized(changed: DataFrame, docs: DataFrame) -> DataFrame:
    return changed.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixture", mixture_stage),
]
#: Near-duplicates by a sketch, a fitted classifier and a range sort are not expressible as one SQL query; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
