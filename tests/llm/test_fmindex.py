from __future__ import annotations

import hashlib
import re

import numpy as np
from conftest import ODD_TEXTS, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from verdance.llm import fmindex

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(TABLE))


def brute(text, items, window):
    w, hit, found = split(text), set(), set()
    for item, phrase in items:
        p = split(phrase)
        size = min(window, len(p))
        for k in range(len(p) - size + 1 if size else 0):
            for i in range(len(w) - size + 1):
                if w[i : i + size] == p[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.lists(st.integers(2, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_index_counts_and_locates(text, phrases):
    index = fmindex.FMIndex(np.array(text), 5)
    width = max(map(len, phrases))
    table = np.array([[0] * (width - len(p)) + p for p in phrases])
    lo, hi = index.ranges(table, (table > 0).sum(1))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_equals_brute_force(spark, rng):
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 9, 10, 11, 25, 40))] + [(10, None), (11, ""), (12, "?!"), (2, prose(rng, 14))]
    docs = []
    for k in range(120):
        text = prose(rng, rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            p = split(rng.choice(items)[1])
            a = rng.randrange(0, max(1, len(p)))
            text += " ; ".join(["", *[w.upper() for w in p[a : a + rng.randrange(1, 30)]], prose(rng, rng.randrange(0, 5))])
        docs.append((k, text))
    docs += [(200 + k, t) for k, t in enumerate(ODD_TEXTS)] + [docs[0], docs[0], (None, docs[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = fmindex.contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, window=10).collect()
    texts = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(texts[r.doc_id], items, 10)


def test_parts_and_removal(spark, rng, monkeypatch):
    items = [(k, prose(rng, 30)) for k in range(6)]
    docs = [(k, prose(rng, 20) + ". " + items[k % 6][1].title() + "! " + prose(rng, 15)) for k in range(12)] + [(50, prose(rng, 60)), (51, items[0][1]), (52, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*d, "y", 1) for d in docs], "doc_id long, text string, n_hit string, items int")
    whole = sorted(map(tuple, fmindex.contamination(df, benchmark).drop("items").collect()))
    monkeypatch.setattr(fmindex, "PART_WORDS", 60)
    assert sorted(map(tuple, fmindex.contamination(df, benchmark).drop("items").collect())) == whole
    cleaned = fmindex.remove_contamination(df, benchmark)
    assert cleaned.columns == df.columns
    out = {r.doc_id: r.text for r in cleaned.collect()}
    assert not fmindex.contamination(cleaned, benchmark).filter("contaminated").count()
    assert out[50] == docs[12][1] and out[51] == "" and out[52] is None
    assert split(out[0]) == split(docs[0][1])[:20] + split(docs[0][1])[50:]
    assert fmindex.contamination(df, benchmark.limit(0)).filter("contaminated").count() == 0
    assert fmindex.contamination(df.limit(0), benchmark).count() == 0
