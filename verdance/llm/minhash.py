"""Near-duplicate documents by HyperMinHash.

Each document's set of word shingles is cut down to 256 registers (leading-zero count and mantissa bits of the smallest
hash in a bucket). Bands of registers propose pairs, the registers' collision-corrected Jaccard estimate prunes them, and
full shingle sets decide. Equal sets are one class and take part once; their copies join again at the end.

Pairs of a band's bucket are not listed: first each member meets the bucket's smallest document. Where a bucket still holds
several components, its members are dealt in blocks: first with their registers only, which tell the members that have a
likely partner in the block, and then those members with their shingle sets. A task takes a pair in the first band that it
shares, passes over pairs that the estimate rules out or that are connected by now, and confirms the rest, likeliest first;
only links that join two components leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_LUT, SPACE_WORDS, U64, as_signed, cut, mix, shingle_hashes, slices, utf8, word_hashes, words
from .graph import connected_components, loose

REGISTERS, MANTISSA = 256, 10
EMPTY = 0xFFFF
#: Rows of a block, parts that a bucket's rows are salted into, and the chance that a pair at the threshold shares no band.
BLOCK, SALTS, MISSED = 1024, 16, 1e-4


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    data, offs = utf8(texts)
    for lo, hi in slices(offs):
        part, at = LOWER_LUT[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        s, e, first = words(part, at, SPACE_WORDS)
        h, bounds = shingle_hashes(word_hashes(part, s, e), first, size)
        for i in range(hi - lo):
            yield np.unique(h[bounds[i] : bounds[i + 1]])


def registers(u: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit hashes: 6 bits of leading zeros, then the mantissa bits below the leading one."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    bucket = (u >> U64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first of a bucket is its smallest
    rest = u[first] & U64((1 << 56) - 1)
    exponent = np.frexp((rest >> U64(3)).astype(np.float64))[1]  # 53 bits are exact in a double
    zeros = np.minimum(53 - exponent, 40)
    mantissa = ((rest << zeros.astype(U64)) >> U64(56 - 1 - MANTISSA)) & U64((1 << MANTISSA) - 1)
    out[bucket[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


def chances(n: np.ndarray) -> np.ndarray:
    """For sets of n hashes, the probability that a register has each number of leading zeros."""
    z = np.arange(41)
    return np.exp(-np.outer(n / REGISTERS, 2.0 ** -z[1:])) - np.exp(-np.outer(n / REGISTERS, 2.0 ** -z[:-1]))


def jaccard_estimate(a: np.ndarray, b: np.ndarray, chances_a: np.ndarray, chances_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates for pairs of register rows, and the number of registers that they rest on.

    Registers can agree by chance when their smallest hashes differ but share zeros and mantissa; the expected number of
    such registers, from both set sizes, is taken off.
    """
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    expected = (chances_a * chances_b).sum(1) * 2.0**-MANTISSA * REGISTERS
    return np.clip((same - expected) / np.maximum(used - expected, 1), 0, 1), used


def band_size(percent: int) -> int:
    """The most registers of a band with which a pair at the threshold, all registers filled, shares none with chance MISSED at most."""
    return next(b for b in range(8, 0, -1) if (1 - (percent / 100) ** b) ** (REGISTERS // b) <= MISSED or b == 1)


def band_keys(regs: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each row's bands, their last six bits the band's number, and whether any register of the band is filled."""
    some = regs[:, : REGISTERS // band * band].reshape(len(regs), -1, band)
    number = np.arange(some.shape[1], dtype=U64)
    key = np.zeros(some.shape[:2], U64) + number
    for k in range(band):
        key = mix(key * U64(0xD6E8FEB86659FD93) + some[:, :, k].astype(U64))
    return ((key & ~U64(63)) | (number & U64(63))), (some != EMPTY).any(2)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, xors, regs = [], [], [], []
            for u in shingle_sets(batch.column(2), size):
                m = mix(u)
                n.append(len(u))
                total.append(m.sum(dtype=U64))
                xors.append(np.bitwise_xor.reduce(m ^ (m << U64(1))) if len(m) else U64(0))
                regs.append(registers(u).tobytes() if len(u) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(as_signed(np.array(total, U64))), pa.array(as_signed(np.array(xors, U64))), pa.array(regs, pa.binary())],
                ["doc_id", "t", "n_shingles", "f1", "f2", "regs"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _bands(band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, filled = band_keys(_matrix(batch.column(1)), band)
            row, at = np.nonzero(filled)
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(key[row, at])), batch.column(0).take(pa.array(row))], ["key", "node"])

    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [100 * (both := len(np.intersect1d(a, b, True))) >= percent * (len(a) + len(b) - both) for a, b in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _runs(results):
    """Batches sorted by their first three columns, cut into whole runs of these for `results`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(k).to_numpy() for k in range(3)]
            if held and tuple(x[0] for x in ids) != last:
                yield results(held)
                held = []
            last = tuple(x[-1] for x in ids)
            tail = np.flatnonzero((ids[0] != last[0]) | (ids[1] != last[1]) | (ids[2] != last[2]))
            split = int(tail[-1]) + 1 if len(tail) else 0
            if split:
                yield results([*held, batch.slice(0, split)])
                held = []
            held.append(batch.slice(split))
        if held:
            yield results(held)

    return run


def _bounds(t: pa.Table) -> Iterator[tuple[int, int]]:
    key, bi, bj = (t[c].to_numpy() for c in RUN)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)]))
    return zip(new, [*new[1:], len(key)], strict=True)


def near_pairs(t: dict, regs: np.ndarray, size: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """Rows (x, y, estimate) of a run's pairs of different labels that the estimate doesn't rule out, in the first band that they share, likeliest first.

    Passed over are pairs whose estimate is five standard deviations below the threshold.
    """
    odds, (bands, filled), here = chances(size), band_keys(regs, band_size(percent)), int(t["key"][0] & 63)
    left, right = np.flatnonzero(t["block"] == t["bi"][0]), np.flatnonzero(t["block"] == t["bj"][0])
    kept = [np.zeros((0, 3), np.int64)]
    step = max(1, 10_000 // max(1, len(right)))
    for s in range(0, len(left), step):
        some = left[s : s + step]
        i, j = np.repeat(some, len(right)), np.tile(right, len(some))
        ok = (label[i] != label[j]) & ((t["node"][i] < t["node"][j]) | (t["bi"][0] != t["bj"][0]))
        i, j = i[ok], j[ok]
        shared = ((bands[i] == bands[j]) & filled[i]).argmax(1)
        i, j = i[shared == here], j[shared == here]
        est, used = jaccard_estimate(regs[i], regs[j], odds[i], odds[j])
        near = est >= percent / 100 - 5 * np.sqrt(0.1275 / np.maximum(used, 1)) - 1 / np.maximum(used, 1)
        kept.append(np.stack([i, j, (est * -1e6).astype(np.int64)], 1)[near])
    kept = np.concatenate(kept)
    return kept[np.argsort(kept[:, 2], kind="stable")]


def _likely(percent: int):
    """From rows (key, bi, bj, block, node, label, n, regs): those rows that have a likely partner in their run, without n and regs."""

    def results(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t, rows = pa.Table.from_batches(parts), []
        columns = {c: t[c].to_numpy() for c in (*RUN, "block", "node")}
        for lo, hi in _bounds(t):
            _, label = np.unique(t["label"].to_numpy()[lo:hi], return_inverse=True)
            if label.max() == 0:
                continue
            pairs = near_pairs({c: x[lo:hi] for c, x in columns.items()}, _matrix(t["regs"].slice(lo, hi - lo)), t["n"].to_numpy()[lo:hi], label, percent)
            rows.append(lo + np.unique(pairs[:, :2]))
        at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
        return t.select(list(range(6))).take(at).combine_chunks().to_batches(max_chunksize=None)[0] if len(at) else parts[0].slice(0, 0).select(list(range(6)))

    return _runs(results)


def _blocks(percent: int):
    """From rows (key, bi, bj, block, node, label, shingles), sorted by the first three: links between different labels, a forest of each run."""

    def results(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t, found = pa.Table.from_batches(parts), ([], [])
        columns = {c: t[c].to_numpy() for c in (*RUN, "block", "node")}
        for lo, hi in _bounds(t):
            _, label = np.unique(t["label"].to_numpy()[lo:hi], return_inverse=True)
            if label.max() == 0:
                continue
            sets, node = [np.frombuffer(x, U64) for x in t["shingles"].slice(lo, hi - lo).to_pylist()], columns["node"][lo:hi]
            size = np.array([len(u) for u in sets])
            kept = near_pairs({c: x[lo:hi] for c, x in columns.items()}, np.stack([registers(u) for u in sets]), size, label, percent)
            for s in range(0, len(kept), 500):
                x, y = kept[s : s + 500, 0], kept[s : s + 500, 1]
                for a, b in zip(*(k[label[x] != label[y]] for k in (x, y)), strict=True):
                    if label[a] == label[b]:
                        continue
                    both = len(np.intersect1d(sets[a], sets[b], True))
                    if 100 * both >= percent * (size[a] + size[b] - both):
                        found[0].append(int(node[a])), found[1].append(int(node[b]))
                        label[label == label[b]] = label[a]
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    return _runs(results)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in shingle_sets(batch.column(1), size)], pa.binary())], ["node", "shingles"])

    return run


RUN = ("key", "bi", "bj")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs: classes of documents linked at Jaccard >= percent/100.

    Words are runs of non-space characters after A-Z are lower-cased; a text of fewer than `shingle` words, but not none, is
    one shingle. Null and wordless texts have no shingles and link with nothing; texts of any length take part whole. Ids may
    be of any type with an order. Rows with a null id are counted but not linked: component_id is null and kept true. Rows that
    repeat an id are compared each by its own text, and component_id tells the smallest id; identical rows share their
    result. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    band, id_type = band_size(percent), docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.mapInArrow(_sketch(shingle), f"doc_id {id_type}, t long, n_shingles long, f1 long, f2 long, regs binary"))
    equal = ["n_shingles", "f1", "f2"]
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy(*equal).agg(F.min("doc_id").alias("doc_id"), F.min_by("t", "doc_id").alias("t"))
    classes = cut(classes.withColumn("node", F.xxhash64(*equal)))  # ids may repeat, so classes have names of their own
    sketches = rows.select("doc_id", "t", *equal, "regs").join(classes, ["doc_id", "t", *equal])
    sketches = cut(sketches.select("node", F.col("n_shingles").alias("n"), "regs").dropDuplicates(["node"]))
    banded = sketches.select("node", "regs").mapInArrow(_bands(band), "key long, node long")
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    shared = cut(banded.join(loose(hubs, "key"), "key"))
    pairs = shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    partnered = shared.select("node").distinct().join(loose(classes.select("node", "doc_id", "t"), "node"), "node")
    texts = cut(docs.join(partnered, ["doc_id", "t"]).dropDuplicates(["doc_id", "t", "node"]).select("node", "text"))

    def confirmed(found: DataFrame) -> DataFrame:
        with_a = found.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
        return cut(both.mapInArrow(_confirm(shingle, percent), "a long, b long"))

    edges = confirmed(pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_components(edges)

    labelled = shared.filter("members > 2").join(loose(labels, "node"), "node", "left").select("key", "node", "members", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_rows = cut(
        labelled.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        .join(loose(mixed, "key"), ["key", "salt"], "left_semi")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "label")
    )
    run = "key long, bi int, bj int, block int, node long, label long"
    with_regs = open_rows.join(loose(sketches, "node"), "node").select(*RUN, "block", "node", "label", "n", "regs").repartition(*RUN).sortWithinPartitions(*RUN)
    likely = cut(with_regs.mapInArrow(_likely(percent), run))
    wanted = loose(likely.select("node").distinct(), "node")
    sets = texts.join(wanted, "node", "left_semi").mapInArrow(_sets(shingle), "node long, shingles binary")
    dealt = likely.join(sets, "node").select(*RUN, "block", "node", "label", "shingles").repartition(*RUN).sortWithinPartitions(*RUN)
    more = cut(dealt.mapInArrow(_blocks(percent), "u long, v long"))
    components = connected_components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    named = classes.withColumnRenamed("doc_id", "least_id").join(loose(components, "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = cut(named.select(*equal, "least_id", "component"))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(loose(smallest, "component"), "component").select(*equal, "component_id")
    out = rows.select("doc_id", *equal).join(loose(named, *equal), equal, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
