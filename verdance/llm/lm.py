"""Language-model scoring by logistic context mixing over hashed-context bit predictors, with a unigram base score.

A text is a sequence of lower-cased bytes and an end symbol. Each symbol is a path of binary decisions in a Huffman tree of the
training bytes. Five predictors know a decision by its node and the last 0 to 4 bytes, from counts of ones and zeros over all
training documents. All counts are exact. Those without context and after one byte have a place each in a table of fixed size. Longer
contexts stay partitioned, so that what is known of them grows with the corpus: grams, that is four context bytes and a symbol, are
dealt into shards by their last two context bytes, and where these have many grams by the third as well. So a shard has all grams
of its contexts of three and four bytes, and gets the symbol counts of its few contexts of two bytes with them. The predictors' logits are mixed by weights that a gate chooses (how often the two longest
contexts have been seen), and an adaptive probability map, by the last byte, refines the result.

Weights and map learn online from all training text. Each decision is predicted from counts without itself; equal contexts and
symbols predict alike, so they are learned from together, with their number. In each round every shard is passed online, from
the weights and map of the round before, and the shards' results are added up by precision. The number of rounds is fixed. Then
weights and map are frozen, and each shard gives the costs of its grams, those of documents that are not learned from included:
documents can be scored anywhere and in any order, and the same five symbols always cost the same.

Documents travel in chunks of a few megabytes. A chunk asks for its distinct words (the base score looks them up in the training
counts) and its distinct grams once, so both lookups are joins on distinct keys, not on tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_LUT, SPACE_WORDS, U64, as_signed, cut, mix, slices, utf8, word_hashes, words
from .graph import loose

CHUNK_BYTES, SLICE_BYTES = 8_000_000, 1_000_000
END, ORDERS = 256, 5
#: Orders that are one table: a slot for each node, without context and after each byte; and where the slots of each begin.
LOW, SLOT_START = 2, np.array([0, 1 << 9, (1 << 9) + (1 << 17)])
GATES, CELLS = 48, 33
#: Rounds over all training text, distinct grams of a shard, and the weight of where a pass begins, in decisions.
ROUNDS, SHARD_GRAMS, PRIOR = 3, 50_000, 16.0


# -- chunks of documents


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, held, learned, text) packed: one row per chunk, texts compressed."""
    codec, nth = pa.Codec("zstd", compression_level=1), 0
    base = TaskContext.get().partitionId() << 32
    parts: list[tuple] = []

    def pack() -> pa.RecordBatch:
        nonlocal nth, parts
        raw = np.concatenate([p[3] for p in parts])
        sizes = np.concatenate([np.diff(p[4]) for p in parts]).astype(np.int64)
        row = [base + nth, np.concatenate([p[0] for p in parts]).tobytes(), np.concatenate([p[1] for p in parts]).tobytes(), np.concatenate([p[2] for p in parts]).tobytes(), sizes.tobytes(), len(raw), codec.compress(raw.tobytes(), asbytes=True)]
        nth, parts = nth + 1, []
        names = ["chunk", "ids", "named", "flags", "sizes", "bytes", "texts"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    size = 0
    for batch in batches:
        data, offs = utf8(batch.column(3))
        ids = batch.column(0)
        flags = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
        for lo, hi in slices(offs, CHUNK_BYTES):
            if parts and size + offs[hi] - offs[lo] > CHUNK_BYTES:
                yield pack()
                size = 0
            some = ids.slice(lo, hi - lo)
            parts.append((some.fill_null(0).to_numpy().astype(np.int64), some.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), flags[lo:hi], LOWER_LUT[data[offs[lo] : offs[hi]]], offs[lo : hi + 1]))
            size += int(offs[hi] - offs[lo])
    if parts:
        yield pack()


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    """ids, whether the id is not null, flags (1: held out, 2: learned from), bytes, offsets."""
    raw = pa.Codec("zstd").decompress(row["texts"], row["bytes"], asbytes=True) if row["bytes"] else b""
    sizes = np.frombuffer(row["sizes"], np.int64)
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], np.uint8), np.frombuffer(row["flags"], np.uint8), np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _word_slices(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slice by slice of a chunk: its rows, word hashes, the words' row bounds, and their first and end bytes within the slice."""
    for lo, hi in slices(offs, SLICE_BYTES):
        part = data[offs[lo] : offs[hi]]
        s, e, first = words(part, offs[lo : hi + 1] - offs[lo], SPACE_WORDS)
        yield lo, hi, word_hashes(part, s, e), first, s, e


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, chunk, n): a chunk's distinct words and their number in its learned documents."""
    for row in _each(batches):
        _, _, flags, data, offs = _unpack(row)
        found, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for lo, hi, h, first, _, _ in _word_slices(data, offs):
            learned = np.repeat((flags[lo:hi] & 2) > 0, np.diff(first))
            for some in (True, False):
                u, n = np.unique(h[learned == some], return_counts=True)
                found.append(u), counts.append(n * some)
        u, at = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), minlength=len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(as_signed(u)), pa.array(np.full(len(u), row["chunk"], np.int64)), pa.array(n, pa.int64())], ["word", "chunk", "n"])


# -- grams: four context bytes and a symbol


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every symbol with the four bytes before it (0 before a text's start), text by text with its end; row bounds."""
    bounds = offs + np.arange(len(offs))
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    text = np.zeros(bounds[-1] + 4, np.uint8)  # from its fifth byte on, with a zero for each end
    text[4:][inside] = data
    key = np.ndarray(bounds[-1], ">u4", text, strides=(1,)).astype(U64)  # the four bytes before each symbol
    for k in range(4):
        at = bounds[:-1] + k
        key[at[at < bounds[1:]]] &= U64((1 << (8 * k)) - 1)  # not those of the text before
    key <<= U64(9)
    key |= text[4:]
    key[bounds[1:] - 1] |= U64(END)
    return key, bounds


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, chunk, n): a chunk's distinct grams and their number in its learned documents."""
    for row in _each(batches):
        _, _, flags, data, offs = _unpack(row)
        keys, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for lo, hi in slices(offs, SLICE_BYTES):
            key, bounds = grams(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            taught = np.repeat((flags[lo:hi] & 2) // 2, np.diff(bounds))
            u, n = np.unique(key << U64(1) | taught, return_counts=True)  # a sort of values is much faster than one of places
            keys.append(u >> U64(1)), counts.append(n * (u & U64(1)).astype(np.int64))
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), minlength=len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(as_signed(u)), pa.array(np.full(len(u), row["chunk"], np.int64)), pa.array(n)], ["gram", "chunk", "n"])


# -- the mixing model


@dataclass
class Tree:
    """Huffman code of 257 symbols: node and bit of each symbol's steps, -1 after its last."""

    node: np.ndarray
    bit: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Tree:
        heap = [(int(n) + 1, k, k) for k, n in enumerate(counts)]
        heapq.heapify(heap)
        paths: list[list[tuple[int, int]]] = [[] for _ in counts]
        below = {k: [k] for k in range(len(counts))}
        for inner in range(len(counts) - 1):
            (n0, _, a), (n1, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for bit, child in ((0, a), (1, b)):
                for s in below[child]:
                    paths[s].append((inner, bit))
            here = len(counts) + inner
            below[here] = below.pop(a) + below.pop(b)
            heapq.heappush(heap, (n0 + n1, here, here))
        depth = max(map(len, paths))
        node, bit = np.full((len(counts), depth), -1, np.int64), np.zeros((len(counts), depth), np.int64)
        for s, path in enumerate(paths):
            for d, (x, y) in enumerate(reversed(path)):
                node[s, d], bit[s, d] = x, y
        return Tree(node, bit)


def slots(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of each low order for decisions at `node` after the key's context."""
    last = (key >> U64(9)).astype(np.int64) & 255
    return np.column_stack([node, SLOT_START[1] + (last << 9) + node])


def decisions(tree: Tree, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Depth by depth: the keys' places that have a decision there, their nodes and bits."""
    symbol = (key & U64(511)).astype(np.int64)
    for d in range(tree.node.shape[1]):
        at = np.flatnonzero(tree.node[symbol, d] >= 0)
        if len(at):
            yield at, tree.node[symbol[at], d], tree.bit[symbol[at], d]


def _slot_counts(tree):
    """(cell, n) of the low orders: a cell is a slot and a bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOT_START[-1], np.int64)
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
            for at, node, bit in decisions(tree, key):
                cell = (slots(key[at], node) * 2 + bit[:, None]).ravel()
                total += np.bincount(cell, np.repeat(n[at], LOW), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return run


@dataclass
class Decisions:
    """All decisions of a shard's grams, gram by gram, with the zeros and ones that the training text has there by order."""

    at: np.ndarray  # place of the gram
    bit: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    @staticmethod
    def of(tree: Tree, key: np.ndarray, n: np.ndarray, low: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> Decisions:
        """low: zeros and ones by slot. Those of longer contexts are added up here, as the shard has all grams of its contexts, but for
        contexts of two bytes that it shares with other shards: `pairs` has these, sorted, and their counts by symbol."""
        parts = []
        if pairs is not None:
            symbol, depth = np.nonzero(tree.node >= 0)
            below = np.zeros((2, len(tree.node), tree.node.max(initial=0) + 1))
            below[tree.bit[symbol, depth], symbol, tree.node[symbol, depth]] = 1.0
            by_node = [pairs[1].astype(float) @ b for b in below]  # zeros and ones of each pair's nodes
        for at, node, bit in decisions(tree, key):
            zeros, ones = np.empty((len(at), ORDERS)), np.empty((len(at), ORDERS))
            where = slots(key[at], node)
            zeros[:, :LOW], ones[:, :LOW] = low[0::2][where], low[1::2][where]
            for k in range(LOW, ORDERS):
                context = key[at] >> U64(9) & U64((1 << (8 * k)) - 1)
                if k == 2 and pairs is not None:
                    place = np.searchsorted(pairs[0], context.astype(np.int64))
                    zeros[:, k], ones[:, k] = by_node[0][place, node], by_node[1][place, node]
                    continue
                u, same = np.unique(context * U64(512) + node.astype(U64), return_inverse=True)
                for bits, counts in ((0, zeros), (1, ones)):
                    counts[:, k] = np.bincount(same, n[at] * (bit == bits), minlength=len(u))[same]
            parts.append((at, bit, zeros, ones))
        at, bit, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(at, kind="stable")
        return Decisions(at[order], bit[order], zeros[order], ones[order])


def stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gate(n3: np.ndarray, n4: np.ndarray) -> np.ndarray:
    """By how often the contexts of three and four bytes have been seen."""
    level = lambda n, most: np.minimum(np.ceil(np.log2(n + 1)), most).astype(np.int64)
    return level(n4, 7) * 6 + level(n3, 10) // 2


@dataclass
class Mixer:
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.append(np.full(ORDERS, 0.3), 0.0), (GATES, 1)))
    map: np.ndarray = field(default_factory=lambda: np.tile(np.linspace(-8, 8, CELLS), (256, 1)))

    def refine(self, x: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The map's logit, between two cells, and where it lies."""
        place = np.clip((x + 8) * 2, 0, CELLS - 1.001)
        cell = place.astype(np.int64)
        part = place - cell
        return self.map[last, cell] * (1 - part) + self.map[last, cell + 1] * part, cell, part

    def learn(self, key: np.ndarray, n: np.ndarray, d: Decisions, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Online over grams in their order, each for its n occurrences; each from counts without itself.

        A step is the gradient by the curvature so far (of a gate's weights a matrix, of the map by cell), which is returned.
        """
        bend, firm = np.tile(np.eye(ORDERS + 1) * PRIOR, (GATES, 1, 1)), np.full(self.map.shape, PRIOR)
        last, n = ((key >> U64(9)) & U64(255)).astype(np.int64), n.astype(np.float64)
        bounds = np.searchsorted(d.at, np.append(np.arange(0, len(key), block), len(key)))
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            at, bit = d.at[lo:hi], d.bit[lo:hi]
            z, o = np.maximum(d.zeros[lo:hi] - (1 - bit[:, None]), 0), np.maximum(d.ones[lo:hi] - bit[:, None], 0)
            x = np.column_stack([stretch(z, o), np.ones(len(at))])
            g = gate((z + o)[:, 3], (z + o)[:, 4])
            logit = (x * self.weights[g]).sum(1)
            p = squash(logit)
            error = bit - p
            order = np.argsort(g, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                k, some, m = g[rows[0]], x[rows], n[at[rows]]
                bend[k] += (some * (m * np.maximum(p[rows] * (1 - p[rows]), error[rows] ** 2))[:, None]).T @ some
                self.weights[k] += np.linalg.solve(bend[k], (m * error[rows]) @ some)
            c = last[at]
            fine, cell, part = self.refine(logit, c)
            p = squash(fine)
            error = bit - p
            curve, push = np.maximum(p * (1 - p), error**2) * n[at], error * n[at]
            step = np.zeros_like(self.map)
            for there, share in ((cell, 1 - part), (cell + 1, part)):
                np.add.at(firm, (c, there), curve * share)
                np.add.at(step, (c, there), push * share)
            self.map += step / firm
        return bend, firm

    def cost(self, key: np.ndarray, d: Decisions) -> np.ndarray:
        """log10 probability of each key's symbol after its context."""
        x = stretch(d.zeros, d.ones)
        seen = d.zeros + d.ones
        w = self.weights[gate(seen[:, 3], seen[:, 4])]
        logit = (x * w[:, :ORDERS]).sum(1) + w[:, ORDERS]
        fine, _, _ = self.refine(logit, ((key >> U64(9)) & U64(255)).astype(np.int64)[d.at])
        p = np.clip((squash(logit) + squash(fine)) / 2, 1e-6, 1 - 1e-6)
        return np.bincount(d.at, np.log10(np.where(d.bit == 1, p, 1 - p)), minlength=len(key))


def places(keys: np.ndarray):
    """A function from values that are all in the sorted, distinct `keys` to their places there; it bisects only where hashes meet."""
    bits = len(keys).bit_length() + 2
    slot = lambda x: x * U64(0x9E3779B97F4A7C15) >> U64(64 - bits)
    table = np.zeros(1 << bits, np.int32)
    table[slot(keys)] = np.arange(len(keys))

    def find(x: np.ndarray) -> np.ndarray:
        at = table[slot(x)]
        other = np.flatnonzero(keys[at] != x)
        at[other] = np.searchsorted(keys, x[other])
        return at

    return find


def _score(total: int, distinct: int, learned_docs: int, model: bool = True):
    floor = np.log10(total + 1.0 * (distinct + 1))

    def run(key, answers: pa.Table, chunks: pa.Table) -> pa.Table:
        asked, value, is_gram = answers["key"].to_numpy().view(U64), answers["value"].to_numpy(), answers["is_gram"].to_numpy()

        def lookup(mine: np.ndarray):
            order = np.argsort(asked[mine])
            find, values = places(asked[mine][order]), value[mine][order]
            return lambda x: values[find(x)] if len(x) else np.zeros(0)

        count_of, cost_of = lookup(~is_gram), lookup(is_gram)
        out = []
        for row in chunks.to_pylist():
            ids, named, flags, data, offs = _unpack(row)
            base, score = np.full(len(ids), np.log10(learned_docs + 1.0)), np.zeros(len(ids))
            known, tokens = np.full(len(ids), int(learned_docs > 0)), np.ones(len(ids), np.int64)
            for lo, hi, h, first, _, _ in _word_slices(data, offs):
                n = count_of(h)
                of = np.repeat(np.arange(hi - lo), np.diff(first))
                base[lo:hi] += np.bincount(of, np.log10(n + 1.0), minlength=hi - lo)
                known[lo:hi] += np.bincount(of[n > 0], minlength=hi - lo)
                tokens[lo:hi] += np.diff(first)
                if model:
                    gram, at = grams(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    score[lo:hi] = np.add.reduceat(cost_of(gram), at[:-1])
            out.append(pa.table({
                "doc_id": pa.array(ids, mask=named == 0), "held_out": pa.array((flags & 1) > 0), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(ids), total), pa.int64()), "base_score": pa.array(base - tokens * floor),
            } | ({"score": pa.array(score), "bits_per_byte": pa.array(-score / np.log10(2) / (np.diff(offs) + 1))} if model else {})))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in RESULT + OF_MODEL * model})

    return run


RESULT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64())]
OF_MODEL = [("score", pa.float64()), ("bits_per_byte", pa.float64())]


def _shard_of_grams(key: tuple[pa.Scalar, ...], table: pa.Table, pairs: pa.Table) -> pa.Table:
    """A shard's grams in the order of a hash, their numbers, and its contexts of two bytes with their counts by symbol, as one row."""
    gram, n = table["gram"].to_numpy().view(U64), table["n"].to_numpy()
    order, at = np.argsort(mix(gram)), np.argsort(pairs["pair"].to_numpy())
    counts = np.zeros((len(at), END + 1), np.int64)
    for k, (symbols, ns) in enumerate(zip(pairs["symbols"].take(at).to_pylist(), pairs["ns"].take(at).to_pylist(), strict=True)):
        counts[k, symbols] = ns
    row = [gram[order], n[order], pairs["pair"].to_numpy()[at], counts]
    some = row if len(gram) else []  # a shard that only counts were sent to
    return pa.table({c: pa.array([x.tobytes()] if some else [], pa.binary()) for c, x in zip(("grams", "ns", "pairs", "counts"), row, strict=True)})


def passed(mixer: Mixer, key: np.ndarray, n: np.ndarray, d: Decisions) -> np.ndarray:
    """Sums of one shard's pass: by gate the curvature and its product with the weights, by map cell the same."""
    bend, firm = mixer.learn(key, n, d)
    return np.concatenate([bend.ravel(), np.einsum("gij,gj->gi", bend, mixer.weights).ravel(), firm.ravel(), (firm * mixer.map).ravel()])


def added(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map from the shards' sums."""
    w = ORDERS + 1
    bend, aim, firm, level = np.split(sums, np.cumsum([GATES * w * w, GATES * w, 256 * CELLS]))
    return np.linalg.solve(bend.reshape(GATES, w, w), aim.reshape(GATES, w, 1))[:, :, 0], (level / firm).reshape(256, CELLS)


def _shards(batches: Iterator[pa.RecordBatch], tree: Tree, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Decisions]]:
    for row in _each(batches):
        key, n = np.frombuffer(row["grams"], U64), np.frombuffer(row["ns"], np.int64)
        pairs = np.frombuffer(row["pairs"], np.int64), np.frombuffer(row["counts"], np.int64).reshape(-1, END + 1)
        yield key, n, Decisions.of(tree, key, n, low, pairs)


def _round(low, tree: Tree, learned: tuple[np.ndarray, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for key, n, d in _shards(batches, tree, low.value):
            mixer = Mixer(learned[0].copy(), learned[1].copy()) if learned else Mixer()
            taught = n > 0  # other grams are only asked for
            sums = passed(mixer, key[taught], n[taught], _some(d, taught))
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "v"])

    return run


def _some(d: Decisions, wanted: np.ndarray) -> Decisions:
    rows = wanted[d.at]
    return Decisions((np.cumsum(wanted) - 1)[d.at[rows]], d.bit[rows], d.zeros[rows], d.ones[rows])


def _costs(low, tree: Tree, learned: tuple[np.ndarray, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = Mixer(*learned) if learned else Mixer()
        for key, _, d in _shards(batches, tree, low.value):
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(key)), pa.array(mixer.cost(key, d))], ["gram", "cost"])

    return run


def gram_costs(grams_table: DataFrame) -> DataFrame:
    """(gram, cost) of all grams of a table of (gram, n), with n their number in the training text or 0.

    Weights and map are learned on all of them in ROUNDS rounds; the driver gets sums of fixed sizes only.
    """
    symbol = F.col("gram").bitwiseAND(511)
    symbols = grams_table.groupBy(symbol.alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
    counts = np.zeros(END + 1, np.int64)
    for r in symbols:
        counts[r.s] = r.n
    tree, low = Tree.of(counts), np.zeros(2 * SLOT_START[-1])
    cells = grams_table.filter("n > 0").mapInArrow(_slot_counts(tree), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    low[cells.cell.to_numpy()] = cells.n.to_numpy()
    sent, learned = grams_table.sparkSession.sparkContext.broadcast(low), None
    shards = max(1, -(-sum(r.distinct for r in symbols) // SHARD_GRAMS))
    pair, third = F.shiftright("gram", 9).bitwiseAND(0xFFFF), F.shiftright("gram", 25).bitwiseAND(0xFF)
    after = grams_table.groupBy(pair.alias("pair"), symbol.alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct"))
    parts = F.ceil(F.sum("distinct") / SHARD_GRAMS).cast("int").alias("parts")
    pairs = cut(after.groupBy("pair").agg(F.collect_list(F.col("s").cast("int")).alias("symbols"), F.collect_list("n").alias("ns"), parts))  # at most 65,536 rows
    shard = lambda part: F.pmod(F.xxhash64("pair", part), F.lit(shards)).alias("shard")
    own = pairs.select("pair", "symbols", "ns", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_k")).select(shard(F.col("_k")), "pair", "symbols", "ns").dropDuplicates(["shard", "pair"])
    placed = grams_table.withColumn("pair", pair).join(F.broadcast(pairs.select("pair", "parts")), "pair").select(shard(F.pmod(F.xxhash64(third), F.col("parts")).cast("int")), "gram", "n")
    dealt = cut(placed.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_shard_of_grams, "grams binary, ns binary, pairs binary, counts binary"))
    for _ in range(ROUNDS if counts.any() else 0):
        sums = np.zeros(GATES * (ORDERS + 1) * (ORDERS + 2) + 512 * CELLS)
        for r in dealt.mapInArrow(_round(sent, tree, learned), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            sums[r.cell] = r.v
        learned = added(sums)
    return dealt.mapInArrow(_costs(sent, tree, learned), "gram long, cost double")


def score(docs: DataFrame, held_out: Column, learned: Column, id_col: str = "doc_id", text_col: str = "text", model: bool = True) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte; the last two only with `model`.

    Tokens are non-space words of the lower-cased text and one end. base_score sums log10((c+1)/(N+V+1)) over them, with c a
    token's count, N all tokens and V the distinct ones of the rows where `learned` is true. score is the mixing model's log10
    probability of the text. Null texts count as empty: one token, the end. Null flags are false; ids may be null or repeat,
    and are long or cast to it (an id that is no number fails as any cast does). Texts of any length are scored whole; other
    columns are ignored. An empty table gives no rows; without a learned row every decision is even. The first six columns need
    words only: without `model` no grams are counted and nothing is learned from them, while these columns come the same way.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held"), learned.alias("learned"), F.col(text_col).alias("text"))
    chunks = cut(rows.mapInArrow(_chunk, "chunk long, ids binary, named binary, flags binary, sizes binary, bytes long, texts binary"))
    asked = chunks.mapInArrow(_dictionary, "word long, chunk long, n long")
    counts = cut(asked.groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    learned_docs = rows.filter("learned").count()
    answered = asked.join(loose(counts, "word"), "word").select("chunk", F.lit(False).alias("is_gram"), F.col("word").alias("key"), F.col("c").cast("double").alias("value"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    if model:
        asked_grams = chunks.mapInArrow(_gram_counts, "gram long, chunk long, n long")
        costs = cut(gram_costs(cut(asked_grams.groupBy("gram").agg(F.sum("n").alias("n")))))
        answered = answered.union(asked_grams.join(loose(costs, "gram"), "gram").select("chunk", F.lit(True).alias("is_gram"), F.col("gram").alias("key"), F.col("cost").alias("value")))
        schema += ", score double, bits_per_byte double"
    run = _score(int(total + learned_docs), int(distinct + (learned_docs > 0)), int(learned_docs), model)
    return answered.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(run, schema)
