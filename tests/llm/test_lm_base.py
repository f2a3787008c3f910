"""The base score alone: no work for the model, and the columns that the whole operator gives."""

from __future__ import annotations

from conftest import ODD_TEXTS, prose
from pyspark.sql import functions as F

from verdance.llm import lm, queries


def counted(monkeypatch) -> list:
    calls, whole = [], lm.gram_costs
    monkeypatch.setattr(lm, "gram_costs", lambda table: calls.append(1) or whole(table))
    return calls


def test_the_query_learns_no_model(spark, rng, monkeypatch, tmp_path):
    rows = [(k, prose(rng, rng.randrange(0, 90))) for k in range(60)] + [(100 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(None, "the stone"), (3, "the river")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls = counted(monkeypatch)
    base = queries.base_scores(spark, str(tmp_path))
    got = sorted(map(repr, base.collect()))
    assert not calls
    whole = queries.op8_context_mixing(spark, str(tmp_path))
    assert len(calls) == 1 and {"score", "bits_per_byte"} <= set(whole.columns)
    assert got == sorted(map(repr, whole.select(*base.columns[:-1], F.round("base_score", 6).alias("base_score")).collect()))


def test_base_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = lm.score(empty, F.lit(False), F.lit(True), model=False)
    assert out.collect() == [] and out.columns == [n for n, _ in lm.RESULT]
    unlearned = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True), F.lit(False), model=False).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in unlearned] == [(3, 0, 0, 0.0)]


def test_chunks_without_words(spark):
    """Only the model asks for anything there, for ends; so the base gets no answers for such a chunk."""
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    more = docs.union(spark.createDataFrame([(4, "a b a")], docs.schema)).repartitionByRange(4, "doc_id")
    for some in (docs, more):
        columns = [n for n, _ in lm.RESULT]
        base = lm.score(some, F.lit(False), F.lit(True), model=False).collect()
        assert sorted(map(repr, base)) == sorted(map(repr, lm.score(some, F.lit(False), F.lit(True)).select(*columns).collect()))
        assert {r.doc_id: (r.n_tokens, r.n_known) for r in base if r.doc_id < 4} == {1: (1, 1), 2: (1, 1), 3: (1, 1)}
