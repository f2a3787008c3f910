from __future__ import annotations

import time

import numpy as np
from conftest import prose

from verdance.llm import fmindex


def test_removal_rechecks_all_parts(spark, rng, monkeypatch):
    a, b = prose(rng, 10).split(), prose(rng, 10).split()
    benchmark = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string")
    rows = [(1, " ".join(a[:5] + b + a[5:])), (2, " ".join(a[:5] + b[:5] + a + b[5:] + a[5:])), (3, "un related"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (1_000_000, 3):
        monkeypatch.setattr(fmindex, "PART_WORDS", words)
        assert {r.doc_id: r.text for r in fmindex.remove_contamination(docs, benchmark).collect()} == {1: "", 2: "", 3: "un related", 4: None}


def test_long_items_come_in_pieces(spark, rng, monkeypatch):
    items = [(1, prose(rng, 57).title()), (2, prose(rng, 10)), (3, prose(rng, 4)), (4, "?!"), (5, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, prose(rng, 30) + " . " + items[k % 3][1].upper() + " " + prose(rng, 9)) for k in range(9)], "doc_id long, text string")
    whole = sorted(map(tuple, fmindex.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(fmindex, "PIECE_WORDS", 7)
    assert sorted(map(tuple, fmindex.contamination(docs, benchmark).collect())) == whole
    assert all(r[2] > 0 for r in whole)


def test_many_hit_rows_take_linear_time():
    class Held:
        value = fmindex.Phrases([("1", "a b c d e f g h i j")], 10)

    import pyarrow as pa

    def seconds(n: int) -> float:
        batch = pa.RecordBatch.from_arrays([pa.array(["a b c d e f g h i j"] * n), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.string()))], ["t", "s", "i"])
        began = time.perf_counter()
        out = list(fmindex._search(Held, 10, False, False, False)(iter([batch])))
        assert np.array([len(x) for x in out[0].column(1).to_pylist()]).min() == 16
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 10
