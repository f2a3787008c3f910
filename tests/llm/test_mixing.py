from __future__ import annotations

import pytest
from conftest import prose
from pyspark.sql import functions as F

from verdance.llm import mixing


def shares(sizes: dict, weights: dict, passes: int = 3) -> dict:
    """The stated rule, step by step: share by weight, cap, share the excess again."""
    total, out, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(passes * sizes[s] for s in capped)
        weight = sum(w for s, w in weights.items() if s not in capped)
        out = {s: passes * sizes[s] if s in capped else left * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > passes * sizes[s]}
        if not over:
            return out
        capped |= over


def table(spark, rng, sources):
    rows = []
    for source, n in sources.items():
        for _ in range(n):
            rows.append((len(rows), prose(rng, rng.randrange(1, 60)), source, 9))
    rows += [(None, "two words", "b", 9), (None, "two words", "b", 9), (5000, None, "b", 9), (5001, "", None, 9), (1, rows[1][1], rows[1][2], 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target long")


def test_targets_and_taken(spark, rng):
    docs = table(spark, rng, {"a": 4, "b": 300, "c": 40, "d": 8, None: 3, "e": 90})
    got = mixing.mixture(docs).collect()
    assert len(got) == docs.count()
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    order = sorted(s for s in sizes if s is not None) + [None]
    want = shares(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert sum(r.taken for r in mine) == int(want[s] + 0.5)
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_training_order_follows_the_schedules(spark, rng):
    docs = table(spark, rng, {"a": 150, "b": 150, "c": 150})
    out = mixing.training_order(docs)
    rows = out.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    taken = {r.source: r.t for r in mixing.mixture(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    for s, t in taken.items():
        assert sum(r.words for r in rows if r.source == s) == t
        assert all(len(r.text.split()) == r.words for r in rows if r.source == s)
    half = lambda s: sum(r.words for r in rows if r.source == s and r.position < 0.5) / max(1, taken[s])
    assert half("a") == pytest.approx(0.5, abs=0.05) and half("b") == pytest.approx(0.375, abs=0.05) and half("c") == pytest.approx(0.625, abs=0.05)


def test_inverse_of_the_integral(spark):
    for schedule in [*mixing.SCHEDULES, [(0.0, 0.0), (0.3, 2.0), (1.0, 1.0)]]:
        grid = spark.range(0, 101).select((F.col("id") / 100).alias("y")).withColumn("t", mixing.time_of(F.col("y"), schedule)).collect()
        for r in grid:
            area = 0.0
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
                x = min(max(r.t - t0, 0), t1 - t0)
                area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert area / mixing.integral(schedule) == pytest.approx(r.y, abs=1e-9)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixture(docs).count() == 0 and mixing.training_order(docs).count() == 0
    wordless = spark.createDataFrame([(1, "", "a"), (2, None, None)], docs.schema)
    assert [(r.size, r.taken, r.target, r.position) for r in mixing.mixture(wordless).collect()] == [(0, 0, 0.0, None)] * 2
