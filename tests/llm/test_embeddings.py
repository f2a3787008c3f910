from __future__ import annotations

import numpy as np

from verdance.llm import embeddings


def brute(x: dict[int, np.ndarray], least: float) -> dict[int, tuple[int, int]]:
    ids = sorted(x)
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    links = {i: [j for j in ids if j != i and len(x[i]) == len(x[j]) and unit[i] @ unit[j] >= least] for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df, **more).collect()}


def test_equals_brute_force_with_blocks_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 24)).astype(np.float32)
    x = {i: base[i % 12] + rng.normal(scale=0.06 * (i % 5), size=24).astype(np.float32) for i in range(900)}
    x |= {900 + i: base[3] for i in range(40)} | {1000 + i: rng.normal(size=24).astype(np.float32) for i in range(200)}
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    got = run(spark, [(i, v.tolist(), 0) for i, v in x.items()], least=0.95)
    want = brute({i: v.astype(np.float32).astype(np.float64) for i, v in x.items()}, 0.95)
    links = sum(n for n, _ in want.values())
    assert sum(n for n, _, _ in got.values()) >= 0.999 * links and all(got[i][0] <= want[i][0] for i in want)
    assert {i: got[i][1] for i in want} == {i: c for i, (_, c) in want.items()}
    assert all(k == (i == c) for i, (_, c, k) in got.items())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], None), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, None], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1.0], 0), (None, [1.0, 0.0], 0)]
    got = run(spark, rows)
    assert got.pop(None) == (0, None, True)
    assert got.pop(1) == (1, 1, True) and got.pop(2) == (1, 1, False)
    assert all(v == (0, i, True) for i, v in got.items())
    assert run(spark, []) == {}


def test_repeated_ids_are_vectors_of_their_own(spark):
    near = [[1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.02, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.01]]
    rows = [("b", near[0]), ("c", near[1]), ("d", near[2]), ("b", near[3]), ("e", near[4]), ("b", near[0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect())
    assert got == [("b", 1, "b"), ("b", 3, "b"), ("b", 3, "b"), ("c", 3, "b"), ("d", 3, "b"), ("e", 1, "b")]


def test_recall_at_the_threshold_for_more_rotations(spark, monkeypatch):
    """Pairs just above the threshold, hashed as a table of a million times as many vectors is."""
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 700, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.951 * a + np.sqrt(1 - 0.951**2) * b
    few, many = embeddings.plan(1400, 48, 0.95), embeddings.plan(10**9, 48, 0.95)
    assert few[0] < many[0] and few[1] < many[1] < embeddings.MOST_TABLES
    monkeypatch.setattr(embeddings, "plan", lambda *_: embeddings_plan)
    for embeddings_plan in (few, many):
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate([a, near]))], "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(df).collect()}
        assert sum(got[i] > 0 for i in range(700)) >= 697
