from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from verdance.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, root string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]))


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def climb(levels, at, now):
    """(siblings, digest folded from `now`) of a node up to the top of its tree."""
    proof = ""
    for nodes in levels[:-1]:
        run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
        own = at % 3
        proof += "".join(run[:own] + run[own + 1 :])
        now, at = sha("".join(run[:own] + [now] + run[own + 1 :])), at // 3
    return proof, now


def tampered(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None


def brute(rows):
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        held = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = held, levels_of([leaf_of(r) for r in held])
    top = levels_of([trees[s][1][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        held, levels = trees[s]
        for at, r in enumerate(held):
            now = leaf_of((*r[:4], r[4].replace("\n", ""))) if tampered(r) else leaf_of(r)
            a, folded = climb(levels, at, now)
            b, folded = climb(top, g, folded)
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0], sha(a + b), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def got_of(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    now = {"text": F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    return sorted(map(tuple, merkle.report(docs, now).collect()), key=repr)


def row(k, source, text):
    return k, source, None if k and k % 5 == 0 else "en", len(text or ""), text, 1, "x"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 400])
def test_sizes(spark, n):
    rows = [row(k * 7 % 1009, "s", f"line {k}\nnext") for k in range(n)]
    assert got_of(spark, rows) == brute(rows)


def test_sources_nulls_and_repeats(spark):
    rows = [row(k, s, t) for k, (s, t) in enumerate([(None, "a\nb"), ("é", None), ("Z", ""), ("a", "x" * 300_000 + "\n"), (None, "\n\n"), ("a", "ü\n🙂"), ("", "q\nr")] * 5)]
    rows += [rows[3], rows[3], (None, "a", None, None, None, None, None), (None, None, None, None, "t\n", 1, "y"), (3, "a", "en", 9, "another\n", 1, "x")]
    rows += [row(1000 + k, f"host{k}", "t\nu") for k in range(40)]
    got = got_of(spark, rows)
    assert got == brute(rows) and {x[-1] for x in got} == {True, False}


def test_blocks_smaller_than_trees(spark, monkeypatch):
    """Frontiers of several rounds and proofs of several walks."""
    monkeypatch.setattr(merkle, "PROOF_LEVELS", 2)
    monkeypatch.setattr(merkle, "FRONTIER_LEVELS", 1)
    rows = [row(k, "hot" if k % 3 else f"s{k % 60}", f"{k}\n") for k in range(700)]
    assert got_of(spark, rows, 7) == brute(rows)


def test_empty(spark):
    assert got_of(spark, []) == []
