"""Secret scanning with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A ledger lists the (blob, rule, rule version) pairs
that have been scanned; only unseen pairs are scanned, once per blob, and findings join back to all paths that hold it.
Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches are leftmost and do not overlap; those whose measured group is too short are dropped after.

    Where the rest of a match is one greedy run of a class, a bound inside the pattern finds the same spans as dropping
    short matches after, as no later start within the run can be longer; it spares listing every short run.

    Patterns take time in proportion to the text and a stack of fixed depth: groups that repeat are possessive, which Java
    loops over. `skip` says what may stand before the next match where trying every character would be quadratic, and
    `holds` a text without which there is no match.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    skip: str = ".*?"
    holds: str = ""


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
_JWT = r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
#: Kinds beyond the base: prefixed service tokens, signed web tokens, private key headers.
MORE_RULES = (
    Rule("prefixed", r"(?:gh[oprsu]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{20,}", 20),
    Rule("jwt", _JWT, 30, skip=rf"(?:[^A-Za-z0-9_-]++|(?!eyJ)[A-Za-z0-9_-]|(?!{_JWT})eyJ[A-Za-z0-9_-]*+)*+", holds="eyJ"),
    Rule("pem", r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]++ )*+PRIVATE KEY-----", 20, holds="-----BEGIN "),
)
RULES = BASE_RULES + MORE_RULES
FINDINGS = "blob string, rule string, rule_version int, start long, end long"
LEDGER = "blob string, rule string, rule_version int"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def empty_ledger(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Findings and ledger to begin with; a JVM-side plan without rows."""
    typed = lambda columns: spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in columns.split(", "))])
    return typed(FINDINGS), typed(LEDGER)


def _matches(text: Column, k: int, rule: Rule) -> Column:
    """Array of structs, or null: each step is the gap since the last match and the match; \\G keeps the search linear."""
    steps = rf"(?s)\G({rule.skip})({rule.pattern})"
    present = F.contains(text, F.lit(rule.holds)) if rule.holds else text.rlike(rf"(?s){rule.pattern}")
    pair = F.arrays_zip(F.regexp_extract_all(text, F.lit(steps), F.lit(0)).alias("step"), F.regexp_extract_all(text, F.lit(steps), F.lit(2)).alias("match"))
    found = F.transform(pair, lambda x, i: F.struct(F.lit(k).alias("rule"), i.alias("nth"), F.length(x["step"]).alias("step"), x["match"].alias("match")))
    return F.when(present, found)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of blobs(blob, text, todo): todo lists the rules to run, by their place. No rows for blobs without findings."""
    each = [F.when(F.array_contains("todo", k), _matches(F.col("text"), k, r)) for k, r in enumerate(rules)]
    found = blobs.select("blob", F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("found")).filter(F.size("found") > 0)
    rows = found.select("blob", F.explode("found").alias("m")).select("blob", "m.rule", "m.nth", "m.step", "m.match")
    upto = Window.partitionBy("blob", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("step").over(upto)
    measured, kind, version = F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("int")
    long_enough = F.lit(False)
    for k, r in enumerate(rules):
        here = F.col("rule") == k
        measured = F.length(F.regexp_extract("match", r.pattern, r.group)) if r.group else F.length("match")
        long_enough = F.when(here, measured >= r.least).otherwise(long_enough)
        kind, version = F.when(here, F.lit(r.kind)).otherwise(kind), F.when(here, F.lit(r.version)).otherwise(version)
    rows = rows.withColumn("end", end).filter(long_enough)
    return rows.select("blob", kind.alias("rule"), version.alias("rule_version"), (F.col("end") - F.length("match")).alias("start"), "end")


def incremental_scan(
    versions: DataFrame, findings: DataFrame | None = None, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) after scanning what is new in versions, any table with a text column (null: empty).

    Findings and ledger of earlier calls come back with the new rows added; pass none to begin. Blobs are kept once however
    many rows hold them: equal texts meet by partial aggregation, so that a blob with many copies is no hot group. A table
    without rows gives empty results. A text of any length is scanned whole, in time proportional to it. Columns of versions
    other than the text are not read; ledger rows of unknown rules or with nulls say nothing.
    """
    blobs = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    everything = F.array(*[F.lit(k) for k in range(len(rules))])
    if ledger is None:
        todo = blobs.withColumn("todo", everything)
    else:
        known = F.lit(None).cast("int")
        for k, r in enumerate(rules):
            known = F.when((F.col("rule") == r.kind) & (F.col("rule_version") == r.version), F.lit(k)).otherwise(known)
        seen = ledger.select("blob", known.alias("k")).filter("k is not null").groupBy("blob").agg(F.collect_set("k").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(everything, F.coalesce("seen", F.array().cast("array<int>")))).filter(F.size("todo") > 0)
    new = scan(todo, rules)
    table = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    scanned = todo.select("blob", F.explode(F.transform("todo", lambda k: F.element_at(table, k + 1))).alias("r")).select("blob", "r.rule", "r.rule_version")
    return (findings.unionByName(new) if findings is not None else new), (ledger.unionByName(scanned) if ledger is not None else scanned)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with findings: counts of the base kinds, and base and all spans by start, then kind as listed."""
    nth = F.lit(len(rules))
    for k, r in enumerate(rules):
        nth = F.when(F.col("rule") == r.kind, F.lit(k)).otherwise(nth)
    spans = F.sort_array(F.collect_list(F.struct("start", nth.alias("nth"), "end", F.col("rule").alias("kind"))))
    counts = [F.count_if(F.col("rule") == r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return findings.groupBy("blob").agg(*counts, spans.alias("spans"))


def findings_of_rows(rows: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """rows with their blob's counts and spans (null where it has none), named with a leading found_; a blob of many rows is split by the join, not gathered."""
    own = by_blob(findings, rules)
    own = own.select(F.concat("blob", F.lit("")).alias("found_blob"), *[F.col(c).alias(f"found_{c}") for c in own.columns if c != "blob"])
    clash = [c for c in rows.columns if c in own.columns]
    if clash:
        raise ValueError(f"rows already have {clash}")
    return rows.withColumn("found_blob", blob_id(F.col(text_col))).join(own, "found_blob", "left").drop("found_blob")


def report(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: doc_id, the number of spans of each base kind, their digest, and all spans.

    Ids may be of any type, null or repeated; each row gets its text's spans. Null texts count as empty.
    """
    hit = findings_of_rows(docs.select("doc_id", "text"), findings, rules)
    spans = F.col("found_spans")
    base = F.filter(spans, lambda s: s["nth"] < len(BASE_RULES))
    digest = F.sha2(F.coalesce(_joined(base), F.lit("")), 256)
    counts = [F.coalesce(F.col(f"found_n_{r.kind}"), F.lit(0)).alias(f"n_{r.kind}") for r in BASE_RULES]
    return hit.select("doc_id", *counts, digest.alias("base_sha256"), F.coalesce(_joined(spans), F.lit("")).alias("spans"))


def redact(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every found span of the text replaced by `mark`, overlapping spans by one; rows without findings as they are.

    docs may have columns of any names; they pass unchanged.
    """
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    hit = findings_of_rows(held, findings.select(*[F.col(c) for c in ("blob", "rule", "start", "end")]), rules, "text")
    text, first = F.col("text"), F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(piece.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    cleaned = F.aggregate("found_spans", first, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    columns = [F.when(F.col("found_spans").isNotNull(), cleaned).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return hit.select(*columns)
