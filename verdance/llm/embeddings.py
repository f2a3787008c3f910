"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

In each table a vector is rotated several times (three rounds of random signs and a Walsh-Hadamard transform); each rotation is
hashed to its nearest signed axis, and the axes name its bucket. The number of rotations grows with the logarithm of the number
of vectors, so that buckets hold few vectors that have nothing to do with each other; the number of tables follows from it, by
simulation of pairs at the threshold. A vector is stored in its own bucket and probes the next nearest one; stored-stored and
stored-probing pairs of a bucket are compared by cosine in double precision.

Only ids are shuffled by bucket, and those alone in a bucket go no further. Buckets of one smallest stored vector, as those of a
group of near copies are in most tables, are compared together, so that a vector is fetched once for all of them; many vectors
are dealt in blocks. A pair that meets in several places counts at the first, which both signatures tell, so nothing has to
gather pairs: a task gives sums of links and a forest of what it found connected. Equal vectors are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix
from .graph import connected_components, loose

PROBES, BLOCK, SMALL = 2, 512, 48
#: The probability of a missed pair at the threshold, buckets for each vector, and rotations and tables at most.
MISSED, ROOM, MOST_ROTATIONS, MOST_TABLES = 3e-4, 16, 5, 60


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each column, in log2(rows) passes."""
    n, width = len(x), 1
    out = x.copy()
    while width < n:
        y = out.reshape(n // (2 * width), 2, width, -1)
        left = y[:, 0] - y[:, 1]
        y[:, 0] += y[:, 1]
        y[:, 1] = left
        width *= 2
    return out / np.asarray(np.sqrt(n), x.dtype)


def _nearest_axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The PROBES nearest signed axes of rotated columns, nearest first, and their coordinates, by column."""
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(3):
        x = _hadamard(x * rng.choice(np.array([-1.0, 1.0], x.dtype), len(x))[:, None])
    far, columns = np.abs(x), np.arange(x.shape[1])
    axes, near = np.empty((x.shape[1], PROBES), np.int64), np.empty((x.shape[1], PROBES))
    for k in range(PROBES):
        at = far.argmax(0)
        near[:, k] = far[at, columns]
        axes[:, k] = at + len(x) * (x[at, columns] < 0)
        far[at, columns] = -1
    return axes, near


def padded_size(dims: int) -> int:
    """Components after zeros are added: a power of two, and enough for three rounds to mix what has few components."""
    return max(32, 1 << max(0, int(dims - 1).bit_length()))


def signatures(x: np.ndarray, tables: int, rotations: int) -> np.ndarray:
    """(rows, tables, PROBES) bucket numbers: first the own bucket, then the others by the distance that leads to them."""
    size = padded_size(x.shape[1])
    padded = np.zeros((size, len(x)), np.float32)
    padded[: x.shape[1]] = x.T
    out = np.empty((len(x), tables, PROBES), np.int64)
    for t in range(tables):
        loss, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for k in range(rotations):
            axes, near = _nearest_axes(padded, t * MOST_ROTATIONS + k)
            worse = (loss[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(len(x), -1)
            best = np.argsort(worse, axis=1, kind="stable")[:, :PROBES]
            loss = np.take_along_axis(worse, best, 1)
            code = np.take_along_axis((code[:, :, None] * (2 * size) + axes[:, None, :]).reshape(len(x), -1), best, 1)
        out[:, t] = code[:, np.minimum(np.arange(PROBES), code.shape[1] - 1)]
    return out


@lru_cache(64)
def plan(vectors: int, dims: int, least: float) -> tuple[int, int]:
    """Rotations and tables for so many vectors of so many components: a pair of cosine `least` is missed with probability MISSED."""
    axes = 2 * padded_size(dims)
    rotations = 1
    while axes**rotations < ROOM * vectors and rotations < MOST_ROTATIONS:
        rotations += 1
    rng = np.random.Generator(np.random.PCG64(11))
    a, b = rng.normal(size=(2, 1500, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = np.where(norm > 1e-9, least * a + np.sqrt(max(0, 1 - least * least)) * b / np.maximum(norm, 1e-9), a)
    sa, sb = (signatures(x, 3, rotations) for x in (a, b))
    met = ((sa == sb[:, :, :1]) | (sb == sa[:, :, :1])).any(2).mean()
    return rotations, int(min(MOST_TABLES, max(4, np.ceil(np.log(MISSED) / np.log(1 - min(met, 0.999))))))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, bytes of the vector as doubles or null, two hashes of them)."""
    for batch in batches:
        column, vectors = batch.column(1), []
        values, offsets = column.values, column.offsets.to_numpy()
        holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        for k, null in enumerate(column.is_null().to_pylist()):
            v = flat[offsets[k] : offsets[k + 1]] + 0.0  # -0.0 becomes 0.0
            bad = null or holes[offsets[k + 1]] > holes[offsets[k]] or not np.isfinite(v).all() or not v.any()
            vectors.append(None if bad else v.tobytes())
        digest = [(0, 0)] * len(vectors)
        for k, v in enumerate(vectors):
            if v is not None:
                m = mix(np.frombuffer(v, np.uint64) + np.arange(len(v) // 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                digest[k] = (int(m.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(m)).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary()), pa.array([d[0] for d in digest], pa.int64()), pa.array([d[1] for d in digest], pa.int64())], ["vec_id", "vector", "h1", "h2"])


def _by_length(vectors: list[bytes], wide: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of vectors with equally many components, as unit vectors in double precision; `wide` tells double from single ones."""
    dims = np.array([len(v) for v in vectors], np.int64) // np.where(wide, 8, 4)
    for n in np.unique(dims):
        at = np.flatnonzero(dims == n)
        x = np.empty((len(at), n))
        for kind, rows in ((np.float64, np.flatnonzero(wide[at])), (np.float32, np.flatnonzero(~wide[at]))):
            x[rows] = np.frombuffer(b"".join(vectors[at[k]] for k in rows), kind).reshape(len(rows), n)
        scaled = x / np.abs(x).max(1, keepdims=True)
        yield at, scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def _sign(tables: int, rotations: int):
    """(node, copies, vector, wide, sig): vectors whose components are all single-precision numbers are kept as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            sig, slim, wide = [None] * len(vectors), [None] * len(vectors), np.ones(len(vectors), bool)
            for at, x in _by_length(vectors, np.ones(len(vectors), bool)):
                s = np.concatenate([signatures(x[k : k + 2048], tables, rotations) for k in range(0, len(x), 2048)])
                for k, i in enumerate(at):
                    v = np.frombuffer(vectors[i], np.float64)
                    with np.errstate(over="ignore"):
                        single = v.astype(np.float32)
                    wide[i] = not (single == v).all()
                    sig[i], slim[i] = s[k].tobytes(), vectors[i] if wide[i] else single.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slim, pa.binary()), pa.array(wide), pa.array(sig, pa.binary())], ["node", "copies", "vector", "wide", "sig"])

    return run


def _entries(tables: int):
    """(key, place, node): a bucket of a table and of a vector length, and the place in the signature; own buckets stand at even places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places = batch.num_rows, tables * PROBES
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            place = np.tile(np.arange(places), n)
            dims = np.repeat(batch.column(2).to_numpy().astype(np.uint64), places)
            key = mix((mix(sig + np.uint64(1)) ^ dims) * np.uint64(0xD6E8FEB86659FD93) + (place // PROBES).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), batch.column(0).take(pa.array(np.repeat(np.arange(n), places)))], ["key", "place", "node"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _compare(tables: int, least: float):
    def linked(t: dict, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row pairs of the runs [lo, hi) with the cosine, at their first meeting place."""
        out = [(np.zeros(0, np.int64),) * 2]
        size = hi - lo
        for r in np.flatnonzero(size > SMALL):
            rows = np.arange(lo[r], hi[r])
            left, right = rows[t["block"][rows] == t["bi"][lo[r]]], rows[t["block"][rows] == t["bj"][lo[r]]]
            for s in range(0, len(left), 256):
                i, j = np.nonzero(t["unit"][left[s : s + 256]] @ t["unit"][right].T >= least)
                out.append(first(t, left[s : s + 256][i], right[j]))
        small = np.flatnonzero(size <= SMALL)
        few = np.concatenate([np.arange(lo[r], hi[r]) for r in small]) if len(small) else np.zeros(0, np.int64)
        after = np.concatenate([np.arange(hi[r] - lo[r] - 1, -1, -1) for r in small]) if len(small) else few
        bounds = np.concatenate([[0], np.cumsum(after)])
        start = 0
        while start < len(few):
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + 40_000, "right")) - 1)
            n = after[start:stop]
            i = np.repeat(few[start:stop], n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            near = np.einsum("ij,ij->i", t["unit"][i], t["unit"][j]) >= least
            out.append(first(t, i[near], j[near]))
            start = stop
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def first(t: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these pairs those that are new here: the smaller node first, whose first common bucket is one of this hub."""
        swap = t["node"][i] > t["node"][j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        ok = t["node"][a] != t["node"][b]
        # in a run dealt in blocks, a pair of one block meets in the run of (block, block) only
        ok &= (t["block"][a] == t["block"][b]) == (t["bi"][a] == t["bj"][a])
        a, b = a[ok], b[ok]
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        for s in range(0, len(a), 100_000):
            x, y = a[s : s + 100_000], b[s : s + 100_000]
            sx, sy = t["sig"][x], t["sig"][y]
            met = np.stack([sx[:, :, 0] == sy[:, :, 0], (sy[:, :, 1:] == sx[:, :, :1]).any(2), (sx[:, :, 1:] == sy[:, :, :1]).any(2)], 2).reshape(len(x), 3 * tables)
            place = met.argmax(1)
            mask = np.where(place % 3 < 2, t["own"][x], t["probed"][x])
            new = met.any(1) & (mask >> (place // 3) & 1 > 0)
            kept.append((x[new], y[new]))
        a, b = (np.concatenate([k[c] for k in kept]) for c in range(2))
        _, one = np.unique(np.stack([a, b], 1), axis=0, return_index=True)  # matmul of a block with itself gives both orders
        return a[one], b[one]

    def results(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        nodes, links, roots = [], [], []
        for at, x in _by_length(whole["vector"].to_pylist(), np.array(whole["wide"].to_pylist(), bool)):
            t = {c: whole[c].to_numpy()[at] for c in ("hub", "bi", "bj", "block", "node", "copies", "own", "probed")} | {"unit": x}
            raw = whole["sig"].to_pylist()
            t["sig"] = np.frombuffer(b"".join(raw[k] for k in at), np.int64).reshape(-1, tables, PROBES)
            changes = np.zeros(len(at), bool)
            for c in KEYS:
                changes |= np.diff(t[c], prepend=t[c][0] - 1) != 0
            lo = np.flatnonzero(changes)
            a, b = linked(t, lo, np.append(lo[1:], len(at)))
            if not len(a):
                continue
            ends = np.concatenate([a, b])
            found, root = _forest(t["node"][a], t["node"][b])
            n = np.zeros(len(found), np.int64)
            np.add.at(n, np.searchsorted(found, t["node"][ends]), t["copies"][np.concatenate([b, a])])
            nodes.append(found), links.append(n), roots.append(root)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (nodes, links, roots)], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(k).to_numpy() for k in range(len(KEYS))]
            if held and rows >= 4000 and tuple(x[0] for x in ids) != last:
                yield results(held)
                held, rows = [], 0
            last = tuple(x[-1] for x in ids)
            tail = np.flatnonzero(np.logical_or.reduce([x != v for x, v in zip(ids, last, strict=True)]))
            split = int(tail[-1]) + 1 if len(tail) else 0
            if split and rows + split >= 4000:
                yield results([*held, batch.slice(0, split)])
                held, rows, batch = [], 0, batch.slice(split)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield results(held)

    return run


KEYS = ("hub", "bi", "bj")


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: links are pairs of cosine >= least, found with probability above 0.999 each.

    A vector that is null, empty or zero, or holds null or non-finite components, links with nothing; neither do vectors of
    different lengths. Rows with a null id don't link: component_id is null, kept true. Rows that repeat an id are vectors of
    their own, of which component_id tells the smallest id. Ids may be of any type with an order. Labels and other columns are
    ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    rows = cut(rows.mapInArrow(_usable, f"vec_id {id_type}, vector binary, h1 long, h2 long"))
    usable = rows.filter("vector is not null and vec_id is not null").withColumn("node", F.xxhash64("h1", "h2"))
    classes = cut(usable.groupBy("node").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.max(F.length("vector")).alias("bytes")))
    n, most = classes.agg(F.count("*"), F.coalesce(F.max("bytes"), F.lit(8))).first()
    rotations, tables = plan(n, most // 8, least)
    one = usable.select("vec_id", "node", "vector").join(loose(classes, "node").withColumnRenamed("least_id", "vec_id").drop("bytes"), ["vec_id", "node"]).dropDuplicates(["vec_id", "node"])
    signed = cut(one.select("node", "copies", "vector").mapInArrow(_sign(tables, rotations), "node long, copies long, vector binary, wide boolean, sig binary"))
    dims = (F.length("vector") / F.when(F.col("wide"), 8).otherwise(4)).cast("long")
    narrow = signed.select("node", "sig", dims.alias("dims")).mapInArrow(_entries(tables), "key long, place int, node long")
    hubs = narrow.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("place") % PROBES == 0, F.col("node"))).alias("hub")).filter("n > 1 and hub is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.col("place") / PROBES).cast("int"))
    own = F.col("place") % PROBES == 0
    met = narrow.join(loose(hubs.select("key", "hub"), "key"), "key").groupBy("hub", "node").agg(F.bit_or(F.when(own, bit).otherwise(0)).alias("own"), F.bit_or(F.when(own, 0).otherwise(bit)).alias("probed"))
    met = cut(met)
    sizes = met.groupBy("hub").agg(F.count("*").alias("members")).filter("members > 1")
    placed = (
        met.join(loose(sizes, "hub"), "hub")
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hub", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "own", "probed")
        .join(loose(signed, "node"), "node")
        .select(*KEYS, "block", "node", "own", "probed", "copies", "vector", "wide", "sig")
    )
    dealt = placed.repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = cut(dealt.mapInArrow(_compare(tables, least), "node long, links long, root long"))
    components = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(components, "node", "left")
    named = cut(named.select("node", "least_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(loose(smallest, "component"), "component").select("node", "n_links", "component_id")
    good = F.col("vector").isNotNull() & F.col("vec_id").isNotNull()
    out = rows.select("vec_id", F.when(good, F.xxhash64("h1", "h2")).alias("node")).join(loose(named, "node"), "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
