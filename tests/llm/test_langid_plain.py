"""Training and prediction against a plain version: dictionaries, loops and the formulas of the method."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from test_langid import SYLLABLES, text

from verdance.llm import langid


def features(t: str) -> dict[int, int]:
    out: dict[int, int] = {}
    t = t.lower()
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            h = 0
            for k, c in enumerate(map(ord, t[i : i + n])):
                h = (c * 0x9E3779B1 + 0x7F4A7C15) if k == 0 else (h ^ (h >> 15)) * 0x85EBCA6B + c * 0xC2B2AE35
                h &= 0xFFFFFFFF
            f = ((h ^ (h >> 13)) * 0x27D4EB2F & 0xFFFFFFFF) >> (32 - langid.BITS)
            out[f] = out.get(f, 0) + 1
    return out


def vector(counts: dict[int, int], idf) -> dict[int, float]:
    v = {f: math.log(1 + n) * idf(f) for f, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {f: x / norm for f, x in v.items()}


def softmax(z: list[float]) -> list[float]:
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_ftrl(rows, classes, passes, alpha, beta, l1, l2, together):
    z, n = {}, {}

    def weight(key):
        x = z.get(key, 0.0)
        return 0.0 if abs(x) <= l1 else (math.copysign(l1, x) - x) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    for _ in range(passes):
        for s in range(0, len(rows), together):
            gradient: dict = {}
            for v, y in rows[s : s + together]:
                p = softmax([sum(x * weight((f, c)) for f, x in v.items()) for c in range(classes)])
                for f, x in v.items():
                    for c in range(classes):
                        gradient[f, c] = gradient.get((f, c), 0.0) + x * (p[c] - (c == y))
            before = {key: weight(key) for key in gradient}
            for key, g in gradient.items():
                old = n.get(key, 0.0)
                n[key] = old + g * g
                z[key] = z.get(key, 0.0) + g - (math.sqrt(n[key]) - math.sqrt(old)) / alpha * before[key]
    return weight


def test_equals_the_plain_version(spark):
    rng = random.Random(5)
    rows = [(k, text(rng, lang, rng.randrange(2, 9)), lang) for k in range(90) for lang in [rng.choice(sorted(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, passes=2)
    df: dict[int, int] = {}
    for _, t, _ in rows:
        for f in features(t):
            df[f] = df.get(f, 0) + 1
    idf = lambda f: math.log((1 + len(rows)) / (1 + df.get(f, 0))) + 1
    order = {r.text: (r.part, r.lang) for r in langid._sample(docs.withColumn("h", langid.F.xxhash64("text")), dict.fromkeys(SYLLABLES, 1), 1500).collect()}
    sample = sorted({(order[t], t, lang) for _, t, lang in rows})
    vectors = [(vector(features(t), idf) | {langid.FEATURES: 1.0}, sorted(SYLLABLES).index(lang)) for _, t, lang in sample]
    weight = plain_ftrl([v for k, v in enumerate(vectors) if k % 5 < 4], 3, 2, 2.0, 1.0, 0.01, 0.1, 16)
    want = np.array([[weight((f, c)) for c in range(3)] for f in range(langid.FEATURES + 1)])
    assert np.allclose(model.weights, want, atol=1e-9)
    z = [[sum(x * weight((f, c)) for f, x in v.items()) for c in range(3)] for k, (v, _) in enumerate(vectors) if k % 5 == 4]
    y = [c for k, (_, c) in enumerate(vectors) if k % 5 == 4]
    loss = lambda t: -sum(math.log(softmax([x / t for x in row])[c]) for row, c in zip(z, y, strict=True))
    assert loss(model.temperature) <= min(loss(model.temperature * f) for f in (0.8, 0.95, 1.05, 1.25)) + 1e-9
    for r in langid.predict(docs.limit(20), model).collect():
        v = vector(features(rows[r.doc_id][1]), idf) | {langid.FEATURES: 1.0}
        p = softmax([sum(x * weight((f, c)) for f, x in v.items()) / model.temperature for c in range(3)])
        assert r.score == pytest.approx(max(p)) and r.lang_pred == sorted(SYLLABLES)[p.index(max(p))]
