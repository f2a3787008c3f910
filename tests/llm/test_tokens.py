from __future__ import annotations

import os

import numpy as np
import pytest
from conftest import ODD_TEXTS, prose

from verdance.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)), reason="no vocabulary file")


def brute(text: str | None, rule: str) -> tuple[int, list[float]]:
    """Token by token, byte by byte."""
    table = tokens.read_ranks(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY))
    encode, _ = tokens.encoder(table)
    raw = (text or "").encode()
    parts = raw.split(b"\n")
    parts = [p + b"\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    owner = [k for k, p in enumerate(parts) for _ in p]
    out, at, ids = [0.0] * len(parts), 0, encode(text or "")
    for t in ids:
        held = owner[at : at + len(table[t])]
        at += len(table[t])
        if rule == "start":
            out[held[0]] += 1
        elif rule == "end":
            out[held[-1]] += 1
        elif rule == "most":
            out[max(sorted(set(held)), key=held.count)] += 1
        else:
            for k in held:
                out[k] += 1 / len(held)
    assert at == len(raw) and b"".join(table[t] for t in ids) == raw
    return len(ids), out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_equals_brute_force(spark, rng, rule):
    texts = [*ODD_TEXTS, "a\n\n\n  b\n", "\n\n\n\n", *["\n".join(prose(rng, rng.randrange(0, 9)) for _ in range(6)) for _ in range(20)]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[4], "x")], "doc_id long, text string, n_tokens string")
    for r in tokens.token_counts(docs, rule).collect():
        n, each = brute(texts[r.doc_id if r.doc_id is not None else 4], rule)
        assert (r.n_tokens, r.n_sections) == (n, len(each)) and r.section_tokens == pytest.approx(each)
    assert tokens.token_counts(docs.limit(0), rule).count() == 0


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "🙂 café noir", [2, 7, 2, 99, -1, None]), (2, "plain", None), (3, None, [1])], "doc_id long, text string, cuts array<int>")
    got = {r.doc_id: r for r in tokens.token_counts(docs, "share", "cuts").collect()}
    assert got[1].n_sections == 3 and sum(got[1].section_tokens) == pytest.approx(got[1].n_tokens)
    assert (got[2].n_sections, got[3].n_sections, got[3].n_tokens) == (1, 0, 0)
    with pytest.raises(ValueError):
        tokens.token_counts(docs, "other")


def test_allocation_of_a_crossing_token():
    edges, ends = np.array([0, 2, 4, 8]), np.array([1, 7, 8])
    assert [tokens.allocate(edges, ends, r)[0].tolist() for r in ("start", "end", "most")] == [[2, 0, 1], [1, 0, 2], [1, 0, 2]]
    assert tokens.allocate(edges, ends, "share")[0] == pytest.approx([1 + 1 / 6, 2 / 6, 3 / 6 + 1])
