"""A Merkle manifest of a dataset, with proofs for each row.

Rows are leaves; those of a source, by ascending id, are the leaves of its tree, and the roots of the trees, by source, those of
the tree above. A parent stands over `ARITY` consecutive nodes, the last one of a level over what is left.

Trees are built by events. A task holds partial parents, which accumulate the digests of their children by place until they have
as many as the size of the tree demands; then the parent is emitted, which is an event for its own parent. First this runs where
the rows already lie, sorted by source and id, without a shuffle. Children whose parents stay partial are the unresolved frontier:
a few nodes a level at either end of a partition. The frontier is shuffled by ever larger blocks of the tree until nothing is left,
in a number of rounds that follows from the largest tree. A parent keeps its children: these reverse links give the proofs, from
the root down, in blocks of seven levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ARITY = 3
#: Levels of a block of proofs, and by how many levels the frontier's blocks grow; a block has at most 3^7 nodes of its lowest level.
PROOF_LEVELS, FRONTIER_LEVELS = 7, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "g long, n long, level int, idx long, digest string"
_PARENT = _NODE + ", children array<string>"
_DIGEST = 64


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: of each value `-` if null, else its UTF-8 byte count, `:` and the value as text."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def size_at(n: int, level: int) -> int:
    """Nodes of a level of a tree over n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_PARENT_ARROW = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in, any order: completed parents with their children out, and at the end the children of parents that stay partial (without children)."""
    partial: dict[tuple[int, int, int], dict[int, str]] = {}
    tree: dict[int, int] = {}
    out: list[tuple] = []
    for g, n, level, idx, digest in _columns(batches):
        tree[g] = n
        here = size_at(n, level)
        while here > 1:
            up, place = idx // ARITY, idx % ARITY
            slots = partial.setdefault((g, level, up), {})
            slots[place] = digest
            if len(slots) < min(ARITY, here - ARITY * up):
                break
            children = [slots[k] for k in range(len(slots))]
            del partial[(g, level, up)]
            level, idx, digest, here = level + 1, up, _sha("".join(children)), -(-here // ARITY)
            out.append((g, n, level, idx, digest, children))
        if len(out) >= 5000:
            yield _batch(out, _PARENT_ARROW)
            out = []
    out += [(g, tree[g], level, up * ARITY + k, digest, None) for (g, level, up), slots in partial.items() for k, digest in slots.items()]
    yield _batch(out, _PARENT_ARROW)


def build(leaves: DataFrame, most: int) -> DataFrame:
    """All parents (g, n, level, idx, digest, children) of the trees g over leaves(g, n, idx, digest), the largest with `most` leaves.

    Where leaves lie sorted by g and idx, nearly all parents are completed without a shuffle.
    """
    nodes = leaves.select("g", "n", F.lit(0).alias("level"), "idx", "digest")
    made = cut(nodes.mapInArrow(_climb, _PARENT))
    parents, levels = made.filter("children is not null"), FRONTIER_LEVELS
    while True:
        frontier = made.filter("children is null").drop("children")
        start = F.col("idx") * F.pow(F.lit(float(ARITY)), F.col("level")).cast("long")
        block = F.floor(start / F.lit(ARITY**levels)).cast("long")
        made = cut(frontier.withColumn("_b", block).repartition("g", "_b").drop("_b").mapInArrow(_climb, _PARENT))
        parents = parents.unionByName(made.filter("children is not null"))
        if ARITY**levels >= most:
            return parents
        levels += FRONTIER_LEVELS


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows sorted over all partitions and numbered from 0 as `name`; they are checkpointed first, as ranges are sampled."""
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", before.alias("_s"))  # one row a partition, so small at any size
    return held.join(F.broadcast(starts), part == F.col("_p")).withColumn(name, F.col("_s") + place).drop("_m", "_p", "_s")


@dataclass(frozen=True)
class Manifest:
    """leaves(g, n, idx, digest, id, now), parents as of build, sources(g, n, source, subroot), above (the parents of the tree of sources) and the root (null without rows)."""

    leaves: DataFrame
    parents: DataFrame
    sources: DataFrame
    above: DataFrame
    root: str | None


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = COLUMNS, now: dict[str, Column] | None = None) -> Manifest:
    """The trees over docs; `now` gives columns of the dataset's present state where it differs, from which the leaf `now` follows.

    Rows without an id come first in their source, equal ids by their digests; rows equal in all columns are leaves of their own.
    A null source is a source of its own and the first. Columns other than the named ones are not read, and texts of any length
    are digested whole; only digests are sorted. An empty table has no root and no leaves.
    """
    then = leaf([F.col(c) for c in columns])
    present = leaf([now.get(c, F.col(c)) for c in columns]) if now else then
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), then.alias("digest"), present.alias("now"))
    rows = numbered(rows, ["source", "id", "digest"], "at")
    each = rows.groupBy("source").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    sources = cut(numbered(each, ["start"], "g"))
    of_source = sources.select("g", "n", "start", F.col("source").alias("_source"))
    leaves = rows.join(of_source, F.col("source").eqNullSafe(F.col("_source")))
    leaves = cut(leaves.select("g", "n", (F.col("at") - F.col("start")).alias("idx"), "digest", "id", "now").repartitionByRange("g", "idx").sortWithinPartitions("g", "idx"))
    most, count = sources.agg(F.max("n"), F.count("*")).first()
    parents = build(leaves, most or 0)
    tops = parents.filter(_is_top()).select("g", F.col("digest").alias("subroot"))
    tops = tops.unionByName(leaves.filter("n = 1").select("g", F.col("digest").alias("subroot")))
    sources = cut(sources.select("g", "n", "source").join(tops, "g"))
    above = build(sources.select(F.lit(-1).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), F.col("g").alias("idx"), F.col("subroot").alias("digest")), count)
    root = (sources.select("subroot") if count == 1 else above.filter(_is_top()).select("digest")).first()
    return Manifest(leaves, parents, sources, above, root[0] if root else None)


def _is_top() -> Column:
    """A level is the top where the one below has at most ARITY nodes, hence where ARITY^level reaches n; idx is 0 there."""
    power = lambda k: F.pow(F.lit(float(ARITY)), k)
    return (F.col("idx") == 0) & (power(F.col("level")) >= F.col("n")) & (power(F.col("level") - 1) < F.col("n"))


# -- proofs: a path is text, one step a level from the node up: the node's place among its siblings, then their digests; steps end in '|'

_PATHS = "g long, idx long, n long, path string, subroot string"
_PATHS_ARROW = pa.schema([("g", pa.int64()), ("idx", pa.int64()), ("n", pa.int64()), ("path", pa.string()), ("subroot", pa.string())])


def steps(path: str) -> list[tuple[str, str]]:
    """What stands before and after the node's own digest, level by level."""
    out = []
    for s in path.split("|")[:-1]:
        cut_at = 1 + int(s[0]) * _DIGEST
        out.append((s[1:cut_at], s[cut_at:]))
    return out


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        digest = _sha(before + digest + after)
    return digest


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[tuple, dict[tuple[int, int], str], list[tuple]]]:
    """For each (g, block) of sorted rows: its path row, the steps of the nodes below it by (depth, idx), and its leaf rows."""
    key, head, below, leaves = None, None, {}, []
    for r in rows:
        if r[:2] != key:
            if head:
                yield head, below, leaves
            key, head, below, leaves = r[:2], None, {}, []
        kind, level, idx, children = r[2], -r[3], r[4], r[9]
        if kind == 0:
            head = r
        elif kind == 1:  # parents, from the top: the path of a child is its own step and its parent's path
            up = below.get((level, idx), head[6])
            for k, _ in enumerate(children):
                step = f"{k}{''.join(children[:k])}{''.join(children[k + 1 :])}|"
                below[(level - 1, idx * ARITY + k)] = step + up
        else:
            leaves.append(r)
    if head:
        yield head, below, leaves


def _descend(level: int):
    """Paths of the nodes of `level` from those at the top of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, below, _ in _blocks(_columns(batches)):
            g, n, subroot = head[0], head[5], head[7]
            yield _batch([(g, idx, n, path, subroot) for (at, idx), path in below.items() if at == level], _PATHS_ARROW)

    return run


def _sorted_blocks(paths: DataFrame, parents: DataFrame, leaves: DataFrame | None, bottom: int, top: int) -> DataFrame:
    """Rows of one walk from `top` down to `bottom`, each block together: path rows (at level `top`, or at the root of a smaller tree), parents from the top, leaves with their present digest as path."""
    null = lambda t: F.lit(None).cast(t)
    a = paths.select("g", F.col("idx").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("depth"), "idx", "n", "path", "subroot", null("string").alias("digest"), null("array<string>").alias("children"))
    width = F.pow(F.lit(float(ARITY)), F.lit(top) - F.col("level")).cast("long")
    inside = parents.filter((F.col("level") > bottom) & (F.col("level") <= top))
    b = inside.select("g", F.floor(F.col("idx") / width).alias("block"), F.lit(1).alias("kind"), (-F.col("level")).alias("depth"), "idx", "n", null("string").alias("path"), null("string").alias("subroot"), "digest", "children")
    rows = a.unionByName(b)
    if leaves is not None:
        c = leaves.select("g", F.floor(F.col("idx") / F.lit(ARITY**top)).alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("depth"), "idx", "n", F.col("now").alias("path"), null("string").alias("subroot"), "digest", null("array<string>").alias("children"))
        rows = rows.unionByName(c)
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "kind", "depth", "idx")


def _tiers(n: Column) -> Column:
    """How many walks of PROOF_LEVELS levels reach from the root of a tree over n leaves to its leaves; at least one."""
    out = F.lit(1)
    for t in range(1, 6):
        out = F.when(n > ARITY ** (PROOF_LEVELS * t), t + 1).otherwise(out)
    return out


def _to_blocks(starts: DataFrame, parents: DataFrame, most: int) -> DataFrame:
    """Paths of the tops of the lowest blocks, from starts(g, n, path, subroot), the path of each tree's root."""
    starts, held = starts.withColumn("idx", F.lit(0).cast("long")).withColumn("_t", _tiers(F.col("n"))), None
    tier = 1
    while ARITY ** (PROOF_LEVELS * tier) < most:
        tier += 1
    for t in range(tier, 0, -1):
        here = starts.filter(F.col("_t") == t).select("g", "idx", "n", "path", "subroot")
        here = here if held is None else here.unionByName(held)
        if t == 1:
            return here
        low, high = PROOF_LEVELS * (t - 1), PROOF_LEVELS * t
        held = cut(_sorted_blocks(here, parents, None, low, high).mapInArrow(_descend(low), _PATHS))
    raise AssertionError


def proofs(m: Manifest) -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof_sha256 (of its siblings' digests from its level up to the root) and folded_root, its present digest folded up along the proof."""
    count = m.sources.count()
    top = m.sources.limit(1).select(F.lit(-1).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    sources = m.sources.select(F.lit(-1).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), F.col("g").alias("idx"), F.col("subroot").alias("digest"), F.col("subroot").alias("now"))

    def to_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, below, leaves in _blocks(_columns(batches)):
            yield _batch([(r[4], 0, 0, below.get((0, r[4]), head[6]), r[8]) for r in leaves], _PATHS_ARROW)

    found = _sorted_blocks(_to_blocks(top, m.above, count), m.above, sources, 0, PROOF_LEVELS).mapInArrow(to_sources, _PATHS)
    starts = m.sources.select("g", "n").join(cut(found).select("g", "path", "subroot"), "g")
    most = m.sources.agg(F.max("n")).first()[0] or 0

    out = "g long, idx long, leaf string, subroot string, proof_sha256 string, folded_root string"
    arrow = pa.schema([("g", pa.int64()), ("idx", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, below, leaves in _blocks(_columns(batches)):
            g, above, subroot, rows = head[0], head[6], head[7], []
            upper = steps(above)
            tail = "".join(x + y for x, y in upper)
            for r in leaves:
                path = below.get((0, r[4]), above)
                own = steps(path[: len(path) - len(above)])
                proof = "".join(x + y for x, y in own) + tail
                rows.append((g, r[4], r[8], subroot, _sha(proof), fold(fold(r[6], own), upper)))
            yield _batch(rows, arrow)

    done = _sorted_blocks(_to_blocks(starts, m.parents, most), m.parents, m.leaves, 0, PROOF_LEVELS).mapInArrow(to_leaves, out)
    ids = m.leaves.select("g", "idx", "id")
    return done.join(ids, ["g", "idx"]).select("id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), "proof_sha256", "folded_root")


def report(docs: DataFrame, now: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Per row of docs: its leaf, its source's root, the root, the digest of its proof, the root as folded from the row's present state, and whether that is the root."""
    out = proofs(manifest(docs, now=now, columns=columns))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
