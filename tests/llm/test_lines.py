from __future__ import annotations

import hashlib
from collections import defaultdict

from conftest import ODD_TEXTS, prose
from pyspark.sql import functions as F

from verdance.llm import lines

FOLD = str.maketrans(lines.UPPER, lines.LOWER)
SCHEMA = "doc_id long, text string, line string, h1 long, last string, id int"


def key(line: str) -> str:
    return line.strip(lines.SPACES).translate(FOLD)


def brute(rows):
    """(id, lines, dropped, digest) of each row; rows are documents, those without an id below all others."""
    held = defaultdict(list)
    for k, text, *_ in rows:
        for line in {key(x) for x in (text or "").split("\n")}:
            held[line].append(k)
    last = {line: max((k for k in ids if k is not None), default=None) for line, ids in held.items() if len(line) >= 40 and len(ids) >= 5}
    out = []
    for k, text, *_ in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if not (key(x) in last and last[key(x)] != k)]
        out.append((k, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng):
    common = [prose(rng, 12) for _ in range(12)] + ["É" * 39 + "x", "Ünïcödé " * 6, "KK" * 20, "kK" * 20, "a" * 39, "b" * 40]
    rows = []
    for k in range(160):
        n = rng.choice([1, 3, 9])
        own = [rng.choice([lambda: prose(rng, 9), lambda: rng.choice(common), lambda: f" \t{rng.choice(common).upper()}\r", lambda: "", lambda: common[0]])() for _ in range(n)]
        rows.append((k * 37 % 1009, "\n".join(own), "l", 1, "z", 2))
    rows += [(None if k == 3 else 2000 + k, t, None, None, None, None) for k, t in enumerate(ODD_TEXTS)]
    rows += [(1500, "\n".join([common[1], common[2]] * 3000), "l", 1, "z", 2), rows[5], rows[5], (rows[5][0], common[3], "l", 1, "z", 2), (3000, common[1] + "\n", "l", 1, "z", 2), (None, common[1], "l", 1, "z", 2)]
    return rows


def test_equals_brute_force(spark, rng):
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, lines.report(docs).collect()), key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) > 3000
    assert lines.report(docs.limit(0)).collect() == []


def test_runs_in_any_order_of_batches(spark, rng):
    """Levels, compaction and what a batch leaves out never change counts that matter, or the largest holder."""
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, SCHEMA)
    keys = lines.keys_of(docs)
    want = sorted(map(tuple, keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter("n >= 5").drop("n").collect()))
    for descending in (True, False):
        runs = lines.Runs(spark, fan_in=2)
        for k in sorted(range(5), reverse=descending):
            part = keys.filter(F.pmod(F.coalesce("id", F.lit(0)), F.lit(5)) == k)
            runs.add(part.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("last")))
        assert sorted(n for n, _ in runs.runs) == [0, 2]  # five batches in pairs: four below one run of the second level, and one
        assert sorted(map(tuple, runs.frequent().collect())) == want
        later = lines.Runs(spark, runs=runs.runs, folder=runs.folder)  # another session, from the list of runs
        before = sum(later._read(p).count() for _, p in later.runs)
        line = keys.join(spark.createDataFrame([want[0]], "h1 long, h2 long, last long"), ["h1", "h2"]).limit(1)
        later.add(line.select("h1", "h2", F.lit(1).cast("long").alias("docs"), F.lit(-5).cast("long").alias("last")))
        assert sum(later._read(p).count() for _, p in later.runs) == before  # frequent and known: the batch adds nothing
        assert sorted(map(tuple, later.frequent().collect())) == want
        later.close()
        runs.close()


def test_any_type_of_id_and_other_columns(spark):
    long = "x" * 50
    docs = spark.createDataFrame([(f"d{k}", f"{long}\nown {k}", k) for k in range(6)], "name string, body string, r1 int")
    got = {r.name: (r.dropped, r.kept, r.r1) for r in lines.dedup(docs, "name", "body").collect()}
    assert got["d5"] == (None, f"{long}\nown 5", 5) and got["d0"] == ([0], "own 0", 0)
    assert lines.dedup(docs.limit(0), "name", "body").columns == ["name", "body", "r1", "dropped", "kept"]
