"""The stages one by one against brute force on a small corpus."""

from __future__ import annotations

import os

import pytest
from conftest import prose
from test_fmindex import split
from test_minhash import brute, edited

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    rng, rows, labels = random.Random(11), [], []
    items = [(k, prose(rng, 25)) for k in range(5)]
    base = prose(rng, 120)
    for k in range(240):
        text, good = prose(rng, rng.randrange(30, 90)), True
        if k % 8 == 0:
            text, good = " ".join(w + "$$$" for w in text.split()), False
        elif k % 8 == 1:
            text = edited(rng, base, rng.randrange(0, 4))
        elif k % 8 == 2:
            text += ". " + items[k % 5][1].upper() + " " + prose(rng, 20)
        elif k % 8 == 3:
            text += " password=Zz9" + "ab" * 6 + " " + prose(rng, 9)
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        if k % 2 == 0 or k % 5 == 0:
            labels.append((k, int(good), 0))
    where = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    steps, docs = {"documents": rows}, spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(where)).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        steps[name] = [r.asDict() for r in docs.collect()]
    return str(where), items, steps


def test_quality_rejects_junk_only(corpus):
    kept = {r["doc_id"] for r in corpus[2]["quality"]}
    assert kept == {k for k in range(240) if k % 8}


def test_one_of_each_group_stays(corpus):
    before = {r["doc_id"]: r["text"] for r in corpus[2]["quality"]}
    component = brute(before, corpus_pipeline.SIMILAR)
    assert {r["doc_id"] for r in corpus[2]["near_duplicates"]} == {k for k, c in component.items() if k == c}


def test_no_passage_is_left(corpus):
    _, items, steps = corpus
    windows = {tuple(split(t)[i : i + 10]) for _, t in items for i in range(16)}
    before = {r["doc_id"]: r["text"] for r in steps["near_duplicates"]}
    for r in steps["decontamination"]:
        w = split(r["text"])
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w)))
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or r["doc_id"] % 8 == 2
    assert {r["doc_id"] for r in steps["decontamination"]} == set(before)


def test_no_secret_is_left(corpus):
    before = {r["doc_id"]: r["text"] for r in corpus[2]["decontamination"]}
    for r in corpus[2]["secrets"]:
        assert ("[secret]" in r["text"]) == (r["doc_id"] % 8 == 3) and "password" not in r["text"]
        assert r["doc_id"] % 8 == 3 or r["text"] == before[r["doc_id"]]


def test_mixture_meets_its_targets(corpus):
    before, rows = corpus[2]["secrets"], corpus[2]["mixture"]
    total = sum(len(r["text"].split()) for r in before)
    assert sum(r["words"] for r in rows) == pytest.approx(total, abs=3)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before}


def test_run_and_columns(spark, corpus):
    where, _, steps = corpus
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(steps[n][0]) == columns for n, _ in corpus_pipeline.STAGES[:-1])
    out = corpus_pipeline.run(spark, where)
    assert sorted((r.doc_id, r.copy, r.words) for r in out.collect()) == sorted((r["doc_id"], r["copy"], r["words"]) for r in steps["mixture"])


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 14))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", ["op1_cross_polytope", "op4_fmindex", "op5_minhash", "op6_curriculum", "op10_secrets", "op11_line_runs", "op12_merkle_manifest", "base_scores"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert len(got) == len(want)
    assert all(a == b or a == pytest.approx(b, rel=1e-9) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))
