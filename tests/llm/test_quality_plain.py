"""Counts, weights, cut and kept rows against a plain version that shares only the word hash and the noise."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_quality import tables

from verdance.llm import quality
from verdance.llm.common import word_hashes

M = 2**64 - 1
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def mix(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def grams(text: str | None) -> list[int]:
    raw = (text or "").encode()
    found = list(WORD.finditer(raw))
    h = [int(word_hashes(np.frombuffer(m[0], np.uint8), np.array([0]), np.array([len(m[0])]))[0]) for m in found]
    shapes = []
    for k, m in enumerate(found):
        w = m[0]
        kind = 1 if re.match(rb"[0-9A-Za-z\x80-\xff]", w) else 2
        upper = (65 <= w[0] <= 90) + 2 * (65 <= w[-1] <= 90 and len(w) > 1)
        size = sum(len(w) >= edge for edge in (2, 3, 5, 9, 17, 33))
        one, two = k >= 1 and h[k - 1] == h[k], k >= 2 and h[k - 2] == h[k]
        shapes.append(mix((kind * 4 + upper) * 32 + size * 4 + one * 2 + (one or two) + 1))
    pairs = [mix((x[k] * 0x9E3779B97F4A7C15 + x[k + 1] + seed) & M) for x, seed in ((h, 7), (shapes, 11)) for k in range(len(h) - 1)]
    return [g >> (64 - quality.BITS) for g in [*h, *pairs]]


def log_ratio(target: dict[int, int], raw: dict[int, int]):
    a, b = (sum(c.values()) + quality.SMOOTHING * quality.BUCKETS for c in (target, raw))
    return lambda g: math.log((target.get(g, 0) + quality.SMOOTHING) / a) - math.log((raw.get(g, 0) + quality.SMOOTHING) / b)


def counted(many) -> dict[int, int]:
    out: dict[int, int] = {}
    for g in many:
        for x in g:
            out[x] = out.get(x, 0) + 1
    return out


def test_equals_the_plain_version(spark, rng):
    docs, labels = tables(spark, rng)
    labels = labels.unionByName(spark.createDataFrame([(k, 0, 0) for k in range(0, 100, 4)] + [(9, 1, 1)], labels.schema))
    c = quality.Classifier(docs, labels)
    rows = [(r.doc_id, r.text, grams(r.text)) for r in docs.collect()]
    marks: dict[int, list] = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            marks.setdefault(r.doc_id, []).append((r.quality, r.toxic or 0))
    marks = {k: (min(q for q, _ in v), max(t for _, t in v)) for k, v in marks.items()}
    fold = {r.id: r.f for r in spark.createDataFrame([(k,) for k in marks], "id long").select("id", F.pmod(F.xxhash64(F.xxhash64("id", F.lit(17))), F.lit(quality.FOLDS)).alias("f")).collect()}
    labelled = [(k, g) for k, _, g in rows if k in marks]
    raw = counted(g for _, _, g in rows)
    target = lambda without: counted(g for k, g in labelled if marks[k] == (1, 0) and fold[k] != without)
    ratios = {f: log_ratio(target(f), raw) for f in (*range(quality.FOLDS), None)}
    weight = lambda g, f=None: sum(map(ratios[f], g))
    good = sorted(weight(g, fold[k]) for k, g in labelled if marks[k][0] == 1)
    bad = sorted(weight(g, fold[k]) for k, g in labelled if marks[k][0] == 0)
    errors = lambda cut: sum(x < cut for x in good) + sum(x >= cut for x in bad)
    at = sorted({*good, *bad})
    middles = [(errors((x + y) / 2), x - y, (x + y) / 2) for x, y in zip(at, at[1:], strict=False)]
    assert c.cut == pytest.approx(min(middles)[2])
    k = sum(weight(g) >= c.cut for _, _, g in rows)
    noise = {r.key: r.g for r in spark.createDataFrame([(str(i) if i is not None else t or "",) for i, t, _ in rows], "key string").select("key", quality._gumbel(F.col("key"), 17).alias("g")).collect()}
    rank = [math.floor((weight(g) + noise[str(i) if i is not None else t or ""]) * 1e6) for i, t, g in rows]
    least = sorted(rank)[-k]
    got = c.report().collect()
    assert c.k == k and sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(i), x >= least) for (i, _, _), x in zip(rows, rank, strict=True))
    assert all(r.n_ngrams == len(g) for r, (_, _, g) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_ngrams)), sorted(rows, key=lambda r: (str(r[0]), len(r[2]))), strict=True))


def test_clashing_columns(spark, rng):
    docs, labels = tables(spark, rng)
    for name in ("_q", "_t", "_label_of", "c0", "label_of", "_rank", "_part", "id", "fold"):
        docs = docs.withColumn(name, F.lit("x"))
    kept = quality.Classifier(docs, labels).kept(docs)
    assert kept.columns == docs.columns and kept.count() > 0
