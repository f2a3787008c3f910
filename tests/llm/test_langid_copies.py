from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_langid import SYLLABLES, text

from verdance.llm import langid
from verdance.llm.common import sampled


def test_copies_stay_in_the_bound(spark, monkeypatch):
    """A text with the lowest hash and 3000 copies: the learner sees it once, and about `per_language` texts in all."""
    rng = random.Random(8)
    rows = [(text(rng, lang, 12), lang) for _ in range(400) for lang in sorted(SYLLABLES)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    hot = docs.orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 52))).first()
    copied = docs.unionByName(spark.range(3000).select(F.lit(hot.text).alias("text"), F.lit(hot.lang).alias("lang")))
    seen = []
    sample = langid._sample
    monkeypatch.setattr(langid, "_sample", lambda *a: seen.append(sample(*a)) or seen[-1])
    langid.train(copied, per_language=60, passes=1)
    langid.train(docs, per_language=60, passes=1)
    first, second = (sorted(map(tuple, s.select("lang", "text").collect())) for s in seen)
    assert len(set(first)) == len(first) < 3 * 60 * 1.5 and abs(len(first) - len(second)) < 10


def test_samples_have_no_least_share(spark):
    hashed = spark.range(400_000).select(F.xxhash64("id").alias("h"))
    assert 20 < hashed.filter(sampled("h", F.lit(1e-4))).count() < 70
    assert hashed.filter(sampled("h", F.lit(1e-9))).count() == 0 and hashed.filter(sampled("h", F.lit(1.0))).count() == 400_000


def test_frequent_languages_of_a_dirty_column(spark):
    rng = random.Random(9)
    rows = [(text(rng, lang, 9), lang) for _ in range(30) for lang in sorted(SYLLABLES)] + [(text(rng, "aa", 3), f"junk{k}") for k in range(50)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), most_languages=3, passes=1)
    assert model.languages == sorted(SYLLABLES)
