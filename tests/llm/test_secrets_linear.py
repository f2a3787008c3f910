from __future__ import annotations

import random
import re

from verdance.llm import secrets

MB = 1 << 20
PLAIN = {"jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"}
PARTS = ["password", "token : ", "secret" + " " * 50, "AKIA", "AKIAAB", "ab0", "gho_", "xoxb-", "eyJ", "eyJa.", "eyJa.b.", "-----BEGIN ", "-----BEGIN A ", "A ", "RSA PRIVATE "]


def test_a_megabyte_of_each_prefix(spark):
    rows = [(k, part * (MB // len(part))) for k, part in enumerate(PARTS)] + [(100 + k, "-----BEGIN " + part * 20_000) for k, part in enumerate(PARTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    findings, _ = secrets.incremental_scan(docs, *secrets.empty_ledger(spark))
    assert secrets.report(docs, findings).count() == len(rows)


def test_same_spans_as_the_plain_patterns(spark):
    rng = random.Random(3)
    pieces = ["eyJ", "eyJab", ".", "a", "x-_", " ", "é🙂", "-----BEGIN ", "RSA ", "PRIVATE ", "KEY-----", "PRIVATE KEY-----", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0.abcdefgh", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    findings, _ = secrets.incremental_scan(docs, *secrets.empty_ledger(spark))
    got = {r.doc_id: {x for x in r.spans.split(",") if x[:3] in PLAIN} for r in secrets.report(docs, findings).collect()}
    least = {r.kind: r.least for r in secrets.RULES}
    for k, t in enumerate(texts):
        assert got[k] == {f"{kind}:{m.start()}:{m.end()}" for kind, p in PLAIN.items() for m in re.finditer(p, t) if len(m[0]) >= least[kind]}, t


def test_columns_of_any_name_pass_redaction(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh", "a", "b", "c")], "doc_id long, text string, found_spans string, found_blob string, row string")
    findings, _ = secrets.incremental_scan(docs)
    assert [tuple(r) for r in secrets.redact(docs, findings).collect()] == [(1, "[secret]", "a", "b", "c")]
    assert secrets.report(docs.withColumn("doc_id", secrets.F.lit("doc-17")), findings).first().doc_id == "doc-17"
