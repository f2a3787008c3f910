from __future__ import annotations

import random

import numpy as np
import pytest

from verdance.llm import langid

SYLLABLES = {"aa": "ka to mi re su no ha chi".split(), "bb": "the ing ough str ent ion".split(), "cc": "süß ein sch ung heit ver".split()}


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_calibration(spark):
    rng = random.Random(3)
    rows = [(k, text(rng, lang, rng.randrange(3, 60)), lang) for k in range(600) for lang in [rng.choice(sorted(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id % 5 <> 0"))
    assert model.languages == sorted(SYLLABLES) and 0 < (model.weights != 0).mean() < 0.9
    truth = {k: lang for k, _, lang in rows}
    got = langid.predict(docs.filter("doc_id % 5 = 0"), model).collect()
    right = [r.lang_pred == truth[r.doc_id] for r in got]
    assert np.mean(right) > 0.98 and abs(np.mean([r.score for r in got]) - np.mean(right)) < 0.05
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, odd):
    model = langid.train(odd)
    assert model.languages == ["en"]
    got = langid.predict(odd, model, ("doc_id", "key", "node")).collect()
    assert len(got) == odd.count()
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert unknown == {None, 1, 2, 9} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.train(odd.limit(0)) is None and langid.train(odd.filter("lang is null")) is None
    assert [r.lang_pred for r in langid.predict(odd.limit(3), None).collect()] == ["und"] * 3
    assert langid.predict(odd.limit(0), model).count() == 0


def test_counts_and_vectors():
    row, feature, count = langid.ngram_counts(["abab", "", "x"])
    assert {int(r): int(count[row == r].sum()) for r in set(row)} == {0: 4 + 3 + 2, 2: 1}
    v = langid.tf_idf(row, feature, count, np.ones(langid.FEATURES), 3)
    assert (v[row == 0] ** 2).sum() == pytest.approx(1)


def test_temperature_minimises_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=langid.softmax(x)) for x in z])
    assert langid.fit_temperature(z * 4, y) == pytest.approx(4, rel=0.1)
