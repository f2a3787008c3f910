"""Every registered query of the library proper against its SQL, over the smallest tables."""

from __future__ import annotations

import os

import pytest

from verdance.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    want = con.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    listed = sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.ORACLES[name]})").fetchall()), key=repr)
    assert len(rows) == len(listed)
    for a, b in zip(rows, listed, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, float) for x in a) else [pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in b] == list(a)


def test_only_these_have_no_sql():
    """A nested document per site; test_products has its hand-computed case."""
    assert catalogue.QUERIES.keys() - catalogue.ORACLES.keys() == {"metrics_document"}
