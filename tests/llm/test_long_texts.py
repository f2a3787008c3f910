"""Texts of a megabyte: taken whole, to their last words, by every operator on documents."""

from __future__ import annotations

import os
import random

import pytest
from conftest import prose
from pyspark.sql import functions as F

from verdance.llm import embeddings, fmindex, langid, lines, lm, merkle, minhash, quality, tokens

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def long() -> str:
    text = prose(random.Random(9), 130_000)
    assert len(text) > 1_000_000
    return text


def test_contamination_in_the_last_words(spark, long):
    passage = "zebra quagga okapi bongo kudu eland oryx gnu topi nyala impala dikdik"
    docs = spark.createDataFrame([(1, f"{long} {passage}"), (2, long)], SCHEMA)
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in fmindex.contamination(docs, items).collect()}
    assert got == {1: (130_012, 12, 1), 2: (130_000, 0, 0)}


def test_near_copies(spark, long):
    words = long.split(" ")
    near, half = " ".join([*words[:-50], *["new"] * 50]), " ".join(words[:65_000])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(5, long), (3, near), (1, half)], SCHEMA), percent=85).collect()}
    assert got == {5: 3, 3: 3, 1: 1}


def test_lines_and_leaves(spark, long):
    shared = "this very line stands in more than five of the documents of this test"
    docs = spark.createDataFrame([(k, f"{long}\n{shared}") if k == 0 else (k, shared) for k in range(6)], SCHEMA)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.report(docs).collect()}
    assert got[0] == (2, 1) and got[5] == (1, 0) and got[1] == (1, 1)
    rows = merkle.report(docs.withColumn("source", F.lit("s")), columns=("doc_id", "text"), now={"text": F.when(F.col("doc_id") == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))})
    assert {r.doc_id: r.verified for r in rows.collect()} == {0: False, **dict.fromkeys(range(1, 6), True)}


@pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)), reason="no vocabulary file")
def test_tokens(spark, long):
    text = f"{long}\nlast line"
    r = tokens.token_counts(spark.createDataFrame([(1, text), (2, long), (3, "last line")], SCHEMA)).orderBy("doc_id").collect()
    assert r[0].n_sections == 2 and sum(r[0].section_tokens) == r[0].n_tokens and r[1].n_tokens <= r[0].n_tokens <= r[1].n_tokens + r[2].n_tokens + 1


def test_language_quality_and_scores(spark, long, rng):
    rows = [(k, prose(rng, 30), "en") for k in range(30)] + [(100 + k, " ".join(rng.choice(["здравствуй", "мир", "дом", "река"]) for _ in range(30)), "ru") for k in range(30)]
    docs = spark.createDataFrame([*rows, (1000, long, "en"), (1001, long + " здравствуй", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[1000] == got[1001] == "en" and got[105] == "ru"
    labels = spark.createDataFrame([(k, int(k < 100), 0) for k, _, _ in rows], "doc_id long, quality int, toxic int")
    n = {r.doc_id: r.n_ngrams for r in quality.Classifier(docs, labels).report().collect()}
    assert n[1001] > n[1000] > 100 * n[0]
    scores = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") >= 1000, F.col("doc_id") < 1000).collect()}
    assert scores[1000].n_tokens == 130_001 and scores[1001].n_tokens == 130_002 and scores[1001].score < scores[1000].score < -100_000


def test_columns_that_clash(spark):
    rows = [(k, [1.0, 0.0, float(k % 2)], 1, 2, "n", "s") for k in range(4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, key int, component_id string, sig string")
    assert {r.vec_id: r.component_id for r in embeddings.near_duplicate_vectors(vectors, least=0.95).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    docs = spark.createDataFrame([(1, "one two three", 5, "x")], "doc_id long, text string, n_hit int, item_id string")
    items = spark.createDataFrame([("i", "two three", 1)], "item_id string, text string, doc_id int")
    assert fmindex.contamination(docs, items).select("n_hit").first()[0] == 2
