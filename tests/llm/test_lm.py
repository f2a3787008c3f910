from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS, prose
from pyspark.sql import functions as F

from verdance.llm import lm

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(TABLE)), None]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string")
    left = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7))
    return lm.score(docs, left == 2, left != 2).collect()


def test_base_equals_brute_force_and_model_learns(spark, rng, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    rows = [(k, prose(rng, rng.randrange(0, 120)), "c") for k in range(300)] + [(1000 + k, t, None) for k, t in enumerate(ODD_TEXTS)] + [(None, "the stone", "c"), (3, "the river", "c")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    count: Counter = Counter()
    for i, t, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(tokens(t))
    total, floor = sum(count.values()), np.log10(sum(count.values()) + len(count) + 1)
    want = sorted((i if i is not None else -1, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), round(sum(np.log10(count[w] + 1) - floor for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 20 and r.doc_id < 1000]
    assert np.mean([r.bits_per_byte for r in held]) < 2.5  # letters alone take over four
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_and_unlearned(spark):
    assert run(spark, []) == []
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = run(spark, [(k, "some text", "c") for k in held])
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, pytest.approx(0.0))] * 3


def test_probabilities_add_up():
    """Over all 257 symbols after any context, and over codes: the tree's paths have no gaps."""
    rng = np.random.default_rng(2)
    tree = lm.Tree.of(rng.integers(0, 1000, lm.END + 1))
    low = rng.integers(0, 50, 2 * lm.SLOT_START[-1]).astype(np.float32)
    mixer = lm.Mixer()
    mixer.weights += rng.normal(scale=0.2, size=mixer.weights.shape)
    for c in rng.integers(0, 2**32, 5, dtype=np.uint64) << np.uint64(9):
        keys = c + np.arange(lm.END + 1, dtype=np.uint64)
        n = rng.integers(0, 9, len(keys))
        assert (10 ** mixer.cost(keys, lm.Decisions.of(tree, keys, n, low))).sum() == pytest.approx(1, abs=1e-9)


def test_grams_keep_to_their_text():
    data = np.frombuffer(b"abcdefxy", np.uint8)
    keys, bounds = lm.grams(data, np.array([0, 6, 6, 8]))
    assert bounds.tolist() == [0, 7, 8, 11]
    symbols = (keys & np.uint64(511)).tolist()
    assert symbols == [*b"abcdef", 256, 256, *b"xy", 256]
    assert [int(k) >> 9 for k in keys[[0, 1, 6, 7, 8, 9]]] == [0, ord("a"), int.from_bytes(b"cdef", "big"), 0, 0, ord("x")]
    assert pa.array(symbols).null_count == 0
