from __future__ import annotations

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from verdance.llm import quality


def tables(spark, rng):
    rows, labels = [], []
    for k in range(400):
        good = k % 4 > 0
        text = prose(rng, rng.randrange(20, 80))
        rows.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split()), "s", 1.0))
        if k % 2:
            labels.append((k, int(good), 0))
    rows += [(None, "the stone river", "s", 1.0), (900, None, "s", 1.0), (901, "", None, 1.0), rows[1], rows[0]]
    labels += [(None, 1, 0), (5000, 1, 0), (7, None, None), (1, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _weight double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rejects_what_labels_call_bad(spark, rng):
    docs, labels = tables(spark, rng)
    labels = labels.unionByName(spark.createDataFrame([(k, 0, 0) for k in range(0, 100, 4)], labels.schema))
    c = quality.Classifier(docs, labels)
    got = c.report().collect()
    assert len(got) == docs.count() and sum(r.kept for r in got) == c.k
    for r in got:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.kept == (r.doc_id % 4 > 0), r
    kept = c.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_weights_equal_a_direct_ratio(spark, rng):
    docs, labels = tables(spark, rng)
    c = quality.Classifier(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ratio = c.ratio.value[0]
    import pyarrow as pa

    for r in c.report().filter("doc_id < 20").collect():
        data, offs = quality.utf8(pa.array([texts[r.doc_id]]))
        _, bucket = quality.features(data, offs)
        assert r.log_weight == pytest.approx(sum(ratio[b] for b in bucket)) and r.n_ngrams == len(bucket)


def test_without_labels_all_stay(spark, rng):
    docs, labels = tables(spark, rng)
    assert quality.Classifier(docs, labels.limit(0)).report().filter("not kept").count() == 0
    assert quality.Classifier(docs.limit(0), labels).report().count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-(10**12), 10**12, 500), np.full(50, 77), rng.integers(-5, 5, 100)])
    df = spark.createDataFrame([(int(v),) for v in x], "v long")
    for k in (1, 2, 100, 333, len(x)):
        assert quality.kth_largest(df, "v", k, bins=16) == np.sort(x)[-k]
    assert quality.kth_largest(df.filter("v is null"), "v", 3) is None


def test_gumbel_noise(spark):
    g = np.array([r[0] for r in spark.range(20_000).select(quality._gumbel(F.col("id").cast("string"), 3)).collect()])
    assert g.mean() == pytest.approx(0.5772, abs=0.03) and g.var() == pytest.approx(np.pi**2 / 6, rel=0.05)
