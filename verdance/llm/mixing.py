"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time [0, 1], given by knots and linear between them. Its integral is the
source's share of all words, capped at a number of passes over the source; its running integral, inverted, turns a word offset
in the source's stream into a training position. Documents stand in a source's stream in the order of a hash of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
Schedule = list[tuple[float, float]]
#: Constant, rising and falling; their integrals are 5, 2 and 1.
SCHEDULES: list[Schedule] = [[(0.0, 5.0), (1.0, 5.0)], [(0.0, 1.0), (1.0, 3.0)], [(0.0, 1.5), (1.0, 0.5)]]


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time by which the schedule has asked for this share of its integral."""
    total, before, out = integral(schedule), 0.0, F.lit(schedule[-1][0])
    steps = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        y = share * F.lit(total) - F.lit(before)
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * y)
        steps.append((before + area, F.lit(t0) + F.when(F.lit(w0) + root > 0, F.lit(2.0) * y / (F.lit(w0) + root)).otherwise(F.lit(0.0))))
        before += area
    for end, t in reversed(steps):
        out = F.when(share * F.lit(total) <= F.lit(end), t).otherwise(out)
    return F.least(out, F.lit(schedule[-1][0]))


def source_targets(sizes: DataFrame, schedules: list[Schedule], passes: int) -> DataFrame:
    """(source, kind, source_size, target), one row per source: words in proportion to the weights, none above passes x size.

    The excess of capped sources goes to the others by weight until none is above. Sources are a small dimension of one row
    each; only their sums meet in one task.
    """
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("kind", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules)).cast("int"))
        .withColumn("weight", F.element_at(weights, F.col("kind") + 1))
        .withColumn("cap", F.col("source_size") * passes)
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = F.col("cap") * F.col("heavier") < (F.col("total") - F.col("below")) * F.col("weight")
    return (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("heavier", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", capped)
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("sharing", F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("left") * F.col("weight") / F.col("sharing")))
        .select("source", "kind", "source_size", "target")
    )


def mixture(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, passes: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' ids with size, source_size, target, offset (its place in the source's word stream), taken and the position of its first copy.

    size counts non-space words (null text: 0). A null source is a source of its own, ranked last. A document that the target
    reaches only partly takes part of its words; no document takes more than `passes` times its size. Documents without words
    take none and have no position. Repeated rows and rows with a null id, which go by their text's hash, each take their own
    place, in the order of their hash, size and text hash. Ids may be of any type, texts of any length; other columns are not
    read. An empty table gives no rows.

    Sources' streams are one range sort of ids and sizes: a task knows its own part of a stream, and sums of parts give where it
    begins, so no source, however large, is one task's. The columns `rank` and `tie` tell a document's place in the order.
    """
    order = ["source", "rank", "size", "tie"]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *document_order(F.col(id_col), F.col(text_col)),
    )
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    held = held.withColumn("_part", F.shiftright("_m", 33))
    parts = held.groupBy("source", "_part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.withColumnRenamed("part_size", "size"), schedules, passes)
    before = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumn("part_start", before).alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("b.source").alias("_s"), F.col("b._part").alias("_b"), "part_start", "kind", "source_size", "target")
    place = Window.partitionBy("source", "_part").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumn("_within", F.coalesce(F.sum("size").over(place), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_b")))
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    part = F.least(F.greatest(goal - whole * F.col("source_size") - F.col("offset"), F.lit(0)), F.col("size"))
    return (
        placed.withColumn("offset", F.col("part_start") + F.col("_within"))
        .withColumn("taken", (whole * F.col("size") + part).cast("long"))
        .withColumn("position", F.when(F.col("taken") > 0, _position("offset", schedules)))
        .select("doc_id", "source", "size", "source_size", "kind", "target", "offset", "taken", "position", "rank", "tie")
    )


def document_order(doc_id: Column, text: Column) -> list[Column]:
    """`rank` and `tie`: documents of a source stand by a hash of their id (of the text where there is none), then by one of the text."""
    return [F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.xxhash64(text).cast("string")))).alias("rank"), F.xxhash64(text).alias("tie")]


def by_position(mixed: DataFrame, *more: str) -> DataFrame:
    """Rows in the order of training, over partitions and within; those without a position come first."""
    return mixed.repartitionByRange("position", "doc_id", *more).sortWithinPartitions("position", "doc_id", *more)


def _position(offset: str, schedules: list[Schedule]) -> Column:
    share = F.least(F.col(offset) / F.floor(F.col("target") + 0.5), F.lit(1.0))
    out = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        out = F.when(F.col("kind") == k, time_of(share, schedule)).otherwise(out)
    return out


def training_order(docs: DataFrame, schedules: list[Schedule] = SCHEDULES, passes: int = 3, keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per copy that the mix takes, range-sorted by training position: doc_id, source, copy, position, words, size and `keep`.

    words is the number of words taken from the copy; it is less than the document's size in a source's last copy only, whose
    text is cut to them. Places are found for ids and sizes alone; the columns to keep, which may have any names but those of the
    result, join them at the end by the document's hashes (128 bits of the id, 64 of the text), once for equal documents.
    """
    names = ["doc_id", "source", "copy", "position", "words", "size"]
    clash = sorted(set(names) & set(keep))
    if clash:
        raise ValueError(f"the result already has {clash}")
    mixed = mixture(docs, schedules, passes).filter("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    copies = copies.withColumn("offset", F.col("offset") + F.col("copy") * F.col("source_size")).withColumn("position", _position("offset", schedules))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    out = copies.select(*names[:4], words.alias("words"), "size", "rank", "tie")
    if keep:
        own = docs.select(*document_order(F.col("doc_id"), F.col("text")), F.struct(*[F.col(c) for c in keep]).alias("_row")).dropDuplicates(["rank", "tie"])
        own = own.select(F.concat("rank", F.lit("")).alias("_rank"), (F.col("tie") + F.lit(0)).alias("_tie"), "_row")  # keys computed anew: a join that can be split
        out = out.join(own, (F.col("rank") == F.col("_rank")) & F.col("tie").eqNullSafe(F.col("_tie")))
        text = F.col("_row")["text"] if "text" in keep else None
        some = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ") if "text" in keep else None
        kept = [F.when(F.col("words") < F.col("size"), some).otherwise(text).alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in keep]
        out = out.select(*names, *kept)
    return by_position(out.select(*names, *keep), "copy")
