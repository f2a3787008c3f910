from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS, prose

from verdance.llm import minhash


def shingles(text: str | None, size: int = 5) -> frozenset:
    import re

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(table))
    return frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1))))


def brute(texts: dict[int, str | None], percent: int) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(rng: random.Random, text: str, n: int) -> str:
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


@pytest.mark.parametrize("percent", [80, 85])
def test_equals_brute_force(spark, rng, monkeypatch, percent):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    texts: dict[int, str | None] = {}
    for family in range(4):
        base = prose(rng, 160)
        for _ in range(60):
            texts[len(texts) + 1] = edited(rng, base, rng.randrange(0, 7))
    for n in (1, 3, 4, 5, 6, 7, 8, 11, 12, 40):
        base = prose(rng, n)
        texts[len(texts) + 1] = base
        texts[len(texts) + 1] = base.upper()
        texts[len(texts) + 1] = base + " more"
        texts[len(texts) + 1] = "more " + base
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, hub string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df, percent=percent).collect()}
    want = brute(texts, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t)) for i, t in texts.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_odd_rows(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_text = {t: len(shingles(t)) for t in ODD_TEXTS}
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept, r.n_shingles) == (None, True, 0)
        elif r.doc_id == 100:
            assert (r.component_id, r.kept) == (5, False)
        else:
            assert r.n_shingles == by_text[ODD_TEXTS[r.doc_id]] and r.component_id == r.doc_id
    assert minhash.near_duplicates(odd.limit(0)).collect() == []


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.85, 0.95):
        n, est = 2000, []
        for _ in range(30):
            common = rng.integers(0, 2**63, int(n * share / (1 + share) * 2 / 2 * 2 // 2 * 1), dtype=np.uint64) * np.uint64(2)
            extra = n - len(common)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, extra, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2))
            true = len(common) / (len(common) + 2 * extra)
            ra, rb = minhash.registers(a)[None], minhash.registers(b)[None]
            c = minhash.chances(np.array([len(a)])), minhash.chances(np.array([len(b)]))
            est.append(minhash.jaccard_estimate(ra, rb, *c)[0][0] - true)
        assert abs(np.mean(est)) < 0.02


def test_sets_are_by_row():
    sets = list(minhash.shingle_sets(pa.array(ODD_TEXTS), 5))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in ODD_TEXTS]


def test_repeated_ids_with_sets_of_equal_size(spark, rng):
    """Two different texts of one id and of as many shingles: a near copy of the first is linked, whichever comes first."""
    first, other = prose(rng, 60), prose(rng, 60)
    copy = first.split(" ")
    copy[30] = "changed"
    rows = [("d5", first), ("d5", other), ("d7", " ".join(copy)), ("d8", other.upper()), ("d9", prose(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [("d5", "d5"), ("d5", "d5"), ("d7", "d5"), ("d8", "d5"), ("d9", "d9")]


def test_bands_follow_the_threshold():
    assert minhash.band_size(85) == 8 and minhash.band_size(80) == 6
    assert all((1 - (p / 100) ** (b := minhash.band_size(p))) ** (minhash.REGISTERS // b) <= 1e-4 for p in range(60, 100))
