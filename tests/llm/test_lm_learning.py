"""Costs against a plain version of the model, learning from all text, and shards that add up."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from verdance.llm import lm


def grams_of(spark, texts, others=()):
    docs = spark.createDataFrame([(k, t, k < len(texts)) for k, t in enumerate([*texts, *others])], "doc_id long, text string, learned boolean")
    rows = docs.select("doc_id", F.lit(False).alias("held"), "learned", "text")
    chunks = rows.mapInArrow(lm._chunk, "chunk long, ids binary, named binary, flags binary, sizes binary, bytes long, texts binary")
    return chunks.mapInArrow(lm._gram_counts, "gram long, chunk long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def costs_of(grams) -> dict[int, float]:
    return {r.gram: r.cost for r in lm.gram_costs(grams).collect()}



def plain(texts, others, order) -> dict[int, float]:
    """The model in loops and dictionaries: one shard, blocks of 4096 grams, the formulas of the docstring."""
    grams: dict[int, int] = {}
    for text, n in [(t, 1) for t in texts] + [(t, 0) for t in others]:
        symbols = [*text.encode().lower(), lm.END]
        for i, s in enumerate(symbols):
            before = ([0] * 4 + symbols)[i : i + 4]
            key = int.from_bytes(bytes(before), "big") << 9 | s
            grams[key] = grams.get(key, 0) + n
    counts = np.zeros(lm.END + 1, np.int64)
    for key, n in grams.items():
        counts[key & 511] += n
    tree = lm.Tree.of(counts)
    paths = {s: [(int(v), int(b)) for v, b in zip(tree.node[s], tree.bit[s], strict=True) if v >= 0] for s in range(lm.END + 1)}
    seen: dict = {}
    name = lambda k, key, node: ("slot", int(lm.slots(np.array([key], np.uint64), np.array([node]))[0, k])) if k < lm.LOW else (k, key >> 9 & (1 << 8 * k) - 1, node)
    names = {(key, node): [name(k, key, node) for k in range(lm.ORDERS)] for key in grams for node, _ in paths[key & 511]}
    for key, n in grams.items():
        for node, bit in paths[key & 511]:
            for x in names[key, node]:
                seen.setdefault(x, [0, 0])[bit] += n
    weights = [np.append(np.full(lm.ORDERS, 0.3), 0.0) for _ in range(lm.GATES)]
    table = np.tile(np.linspace(-8, 8, lm.CELLS), (256, 1))

    def inputs(key, node, bit, without):
        pairs = [[max(seen[x][b] - (without and b == bit), 0) for b in (0, 1)] for x in names[key, node]]
        level = lambda n, most: min(int(np.ceil(np.log2(n + 1))), most)
        return np.array([np.log((o + 0.4) / (z + 0.4)) for z, o in pairs] + [1.0]), level(sum(pairs[4]), 7) * 6 + level(sum(pairs[3]), 10) // 2

    def fine(x, last):
        place = min(max((x + 8) * 2, 0), lm.CELLS - 1.001)
        cell = int(place)
        return table[last, cell] * (1 - place + cell) + table[last, cell + 1] * (place - cell), cell, place - cell

    squash = lambda x: 1 / (1 + np.exp(-x))
    taught = [key for key in order if grams[key]]
    for _ in range(lm.ROUNDS):
        start = [w.copy() for w in weights], table.copy()
        bend, firm = [np.eye(lm.ORDERS + 1) * lm.PRIOR for _ in range(lm.GATES)], np.full(table.shape, lm.PRIOR)
        for s in range(0, len(taught), 4096):
            rows = [(key, bit, *inputs(key, node, bit, True)) for key in taught[s : s + 4096] for node, bit in paths[key & 511]]
            logits = [x @ weights[g] for _, _, x, g in rows]
            push = [np.zeros(lm.ORDERS + 1) for _ in range(lm.GATES)]
            for (key, bit, x, g), y in zip(rows, logits, strict=True):
                p, n = squash(y), grams[key]
                bend[g] += n * max(p * (1 - p), (bit - p) ** 2) * np.outer(x, x)
                push[g] += n * (bit - p) * x
            step = np.zeros_like(table)
            for (key, bit, _, _), y in zip(rows, logits, strict=True):
                last, n = key >> 9 & 255, grams[key]
                f, cell, part = fine(y, last)
                p = squash(f)
                for c, share in ((cell, 1 - part), (cell + 1, part)):
                    firm[last, c] += max(p * (1 - p), (bit - p) ** 2) * n * share
                    step[last, c] += (bit - p) * n * share
            for g in {g for _, _, _, g in rows}:
                weights[g] = weights[g] + np.linalg.solve(bend[g], push[g])
            table += step / firm
        assert start is not None
    out = {}
    for key in grams:
        total = 0.0
        for node, bit in paths[key & 511]:
            x, g = inputs(key, node, bit, False)
            y = x @ weights[g]
            p = min(max((squash(y) + squash(fine(y, key >> 9 & 255)[0])) / 2, 1e-6), 1 - 1e-6)
            total += np.log10(p if bit else 1 - p)
        out[key] = total
    return out


def test_costs_equal_a_plain_version(spark, rng):
    texts, others = [prose(rng, 40) for _ in range(3)] + ["Ünï 漢"], [prose(rng, 15), "never seen"]
    grams = grams_of(spark, texts, others)
    keys = np.array([r.gram for r in grams.collect()]).view(np.uint64)
    order = [int(k) for k in keys[np.argsort(lm.mix(keys))]]
    want, got = plain(texts, others, order), costs_of(grams)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_scores_are_sums_of_costs(spark, rng):
    texts = [prose(rng, 30) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    costs = costs_of(grams_of(spark, texts[:4] + ["", ""], [texts[4]]))
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") == 4, F.col("doc_id") != 4).collect()}
    for k, t in enumerate([*texts, "", ""]):
        symbols = [*t.encode().lower(), lm.END]
        want = sum(costs[int.from_bytes(bytes(([0] * 4 + symbols)[i : i + 4]), "big") << 9 | s] for i, s in enumerate(symbols))
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_all_training_text_is_learned_from(spark, rng):
    """Two million characters, and five scripts that stand in one short document each: no sample of the text is sure to have them."""
    rare = ["жук ждет жары", "αλφα αυτο αιμα", "שלום שמש שיר", "กาล กาง กาย", "한글 한국 한번"]
    texts = [prose(rng, 5000) for _ in range(65)]
    assert sum(map(len, texts)) > 2_000_000
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *rare])], "doc_id long, text string")
    bits = lambda learned: {r.doc_id: r.bits_per_byte for r in lm.score(docs, ~learned, learned).filter("doc_id >= 65").collect()}
    known, unknown = bits(F.lit(True)), bits(F.col("doc_id") < 65)
    assert all(known[k] < 0.6 * unknown[k] for k in known)


def test_shards_add_up(spark, rng, monkeypatch):
    grams = grams_of(spark, [prose(rng, 2000) for _ in range(4)]).cache()
    one = costs_of(grams)
    again = costs_of(grams.repartition(7))
    assert all(again[k] == pytest.approx(one[k], abs=1e-9) for k in one)
    monkeypatch.setattr(lm, "SHARD_GRAMS", 500)
    several = costs_of(grams)
    assert several.keys() == one.keys()
    assert abs(np.mean(list(several.values())) - np.mean(list(one.values()))) < 0.02 * abs(np.mean(list(one.values())))


def test_counts_do_not_depend_on_shards(spark, rng, monkeypatch):
    """Contexts of two bytes that are split over shards keep all their counts; without learning, costs tell counts only."""
    grams = grams_of(spark, [prose(rng, 300) for _ in range(4)], [prose(rng, 50)]).cache()
    monkeypatch.setattr(lm, "ROUNDS", 0)
    one = costs_of(grams)
    monkeypatch.setattr(lm, "SHARD_GRAMS", 10)
    several = costs_of(grams)
    assert several.keys() == one.keys() and all(several[k] == pytest.approx(one[k], abs=1e-9) for k in one)
