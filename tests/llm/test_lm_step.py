"""The step that base_scores and op8_context_mixing share, against plain versions: counts of a chunk, grams, and places of known keys."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import ODD_TEXTS, prose

from verdance.llm import lm


def chunk_of(texts: list[bytes], learned: list[bool]) -> pa.RecordBatch:
    raw = b"".join(texts)
    row = {"chunk": 5, "ids": np.arange(len(texts)).tobytes(), "named": np.ones(len(texts), np.uint8).tobytes(), "flags": (2 * np.array(learned, np.uint8)).tobytes()}
    row |= {"sizes": np.array([len(t) for t in texts], np.int64).tobytes(), "bytes": len(raw), "texts": pa.Codec("zstd").compress(raw, asbytes=True)}
    return pa.RecordBatch.from_pylist([row])


def test_counts_of_a_chunk(rng, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_BYTES", 300)
    texts = [t.lower().encode() for t in [prose(rng, rng.randrange(0, 40)) for _ in range(50)] + [t or "" for t in ODD_TEXTS]]
    learned = [rng.random() < 0.6 for _ in texts]
    batch = chunk_of(texts, learned)
    want: Counter = Counter()
    for t, some in zip(texts, learned, strict=True):
        symbols = [*t, lm.END]
        for i, s in enumerate(symbols):
            want[int.from_bytes(bytes(([0] * 4 + symbols)[i : i + 4]), "big") << 9 | s] += some
    got = pa.Table.from_batches(lm._gram_counts(iter([batch]))).to_pydict()
    assert len(set(got["gram"])) == len(got["gram"]) and dict(zip(got["gram"], got["n"], strict=True)) == want
    tokens = Counter(w for t, some in zip(texts, learned, strict=True) if some for w in t.split())
    found = pa.Table.from_batches(lm._dictionary(iter([batch]))).to_pydict()
    assert len(set(found["word"])) == len(found["word"]) == len({w for t in texts for w in t.split()})
    assert sorted(n for n in found["n"] if n) == sorted(tokens.values())


def test_places_are_exact_where_hashes_meet():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64))
    slots = keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - len(keys).bit_length() - 2)
    assert len(np.unique(slots)) < len(keys)
    assert lm.places(keys)(keys[::-1]).tolist() == list(range(len(keys)))[::-1]
    for few in ([], [0], [0, 2**64 - 1]):
        some = np.array(few, np.uint64)
        assert lm.places(some)(some).tolist() == list(range(len(few)))


def test_lookups_do_not_bisect_every_symbol(rng, monkeypatch):
    """Bisecting for each symbol took half of the last stage's time: few symbols are left for it."""
    data = np.frombuffer(prose(rng, 20_000).encode(), np.uint8)
    keys, _ = lm.grams(data, np.array([0, len(data)]))
    bisected, whole = [], np.searchsorted
    asked, chunks = np.unique(keys), pa.Table.from_batches([chunk_of([data.tobytes()], [True])])
    words = pa.Table.from_batches(lm._dictionary(iter(chunks.to_batches())))["word"].to_numpy()
    answers = pa.table({"key": np.concatenate([asked.view(np.int64), words]), "value": np.ones(len(asked) + len(words)), "is_gram": np.repeat([True, False], [len(asked), len(words)])})
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *more, **named: bisected.append(np.size(v)) or whole(a, v, *more, **named))
    out = lm._score(10, 5, 1)(None, answers, chunks)
    assert out["score"].to_pylist() == [len(keys)]
    assert sum(bisected) < len(keys) / 3
