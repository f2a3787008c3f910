"""Benchmark decontamination by an FM-index per training shard.

A task cuts its documents into shards of a few megabytes. A shard's words become symbols of the benchmark's vocabulary; all
other words are one separator, and runs too short to hold any window are dropped, which can't lose an occurrence. Over that
stream the shard gets a suffix array, its Burrows-Wheeler transform as a wavelet matrix, and suffix positions sampled by text
position. All windows of the benchmark are searched backwards at once, their occurrences located by walking to a sampled
position, and the spans merged.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, LOWER_LUT, cut, slices, utf8, word_hashes, words

SHARD_BYTES, SAMPLE = 2_000_000, 8
#: Words of one benchmark part; a larger benchmark is searched in parts, one pass over the documents for each.
PART_WORDS = 1_000_000
#: Window starts of one piece of an item; longer items come in pieces that overlap by a window less one word.
PIECE_WORDS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of the symbols, from the highest."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for k in reversed(range(levels)):
            bit = (symbols >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position upto, elementwise."""
        lo, hi = np.zeros_like(upto), upto
        for level, k in enumerate(reversed(range(self.levels))):
            ones, one = self.ones[level], ((symbol >> k) & 1).astype(bool)
            lo = np.where(one, self.zeros[level] + ones[lo], lo - ones[lo])
            hi = np.where(one, self.zeros[level] + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; the last symbol is the smallest and stands once."""
    n = len(symbols)
    rank, width = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1 if width < n else 0
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        """symbols: from 1; 0 is put at the end."""
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.ranks = WaveletMatrix(self.last, max(1, int(alphabet - 1).bit_length()))
        self.sampled = order % SAMPLE == 0
        self.positions = order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns, rows padded on the left, by backward search of all at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.last), np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1]):
            live = live[(hi[live] > lo[live])]
            now = live[lengths[live] > k]
            if not len(now):
                break
            c = patterns[now, patterns.shape[1] - 1 - k]
            both = self.ranks.rank(np.concatenate([c, c]), np.concatenate([lo[now], hi[now]]))
            lo[now], hi[now] = self.below[c] + both[: len(now)], self.below[c] + both[len(now) :]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            at = left[done]
            out[at] = self.positions[self.nth[rows[at]]] + steps[at]
            left = left[~done]
            c = self.last[rows[left]]
            rows[left] = self.below[c] + self.ranks.rank(c, rows[left])
            steps[left] += 1
        return out


class Phrases:
    """The distinct windows of benchmark items, and which items have each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        data, offs = utf8(pa.array([text for _, text in items], pa.string()))
        low = LOWER_LUT[data]
        s, e, first = words(low, offs, ALNUM_WORDS)
        self.vocabulary, symbol = np.unique(word_hashes(low, s, e), return_inverse=True)
        symbol = symbol.astype(np.int64) + 2  # 0 ends the text, 1 separates
        self.alphabet = len(self.vocabulary) + 2
        rows, owners = [np.zeros((0, window), np.int64)], []
        for i, (item, _) in enumerate(items):
            w = symbol[first[i] : first[i + 1]]
            if len(w):  # a shorter item's one window is padded on the left
                rows.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(max(0, window - len(w)), np.int64), w]), window))
                owners += [item] * len(rows[-1])
        self.patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        pairs = sorted({(int(p), str(o)) for p, o in zip(of.ravel(), owners, strict=True) if o is not None})
        self.items = np.array([o for _, o in pairs], object)
        self.items_at = np.searchsorted(np.array([p for p, _ in pairs], np.int64), np.arange(len(self.patterns) + 1))
        slots = 1 << max(8, int(len(self.vocabulary) * 8).bit_length())
        self.maybe = np.zeros(slots, bool)
        self.maybe[(self.vocabulary & np.uint64(slots - 1)).astype(np.int64)] = True

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; 1 for words outside the vocabulary."""
        out = np.ones(len(h), np.int64)
        some = np.flatnonzero(self.maybe[(h & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[some]), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == h[some]
        out[some[known]] = at[known] + 2
        return out

    def occurrences(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, number of words, phrase) of every occurrence in a shard whose rows begin at the words `first`."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.patterns) or not len(symbols):
            return none
        # Runs of known words within a row that are long enough; each ends with a separator.
        known = symbols > 1
        cuts = np.zeros(len(symbols) + 1, bool)
        cuts[first] = True
        begins = np.flatnonzero(known & (cuts[:-1] | ~np.concatenate([[False], known[:-1]])))
        ends = np.flatnonzero(known & (cuts[1:] | ~np.concatenate([known[1:], [False]]))) + 1
        fits = ends - begins >= self.shortest
        begins, ends = begins[fits], ends[fits]
        if not len(begins):
            return none
        size = ends - begins + 1
        start = np.cumsum(size) - size
        word = np.repeat(begins - start, size) + np.arange(size.sum())
        stream = np.ones(len(word), np.int64)
        inside = np.ones(len(word), bool)
        inside[start + size - 1] = False
        stream[inside] = symbols[word[inside]]
        index = FMIndex(stream, self.alphabet)
        lo, hi = index.ranges(self.patterns, self.lengths)
        n = hi - lo
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return word[index.locate(rows)], self.lengths[phrase], phrase


def _search(phrases, window: int, final: bool, clean: bool, alone: bool):
    """One part of the benchmark over batches (row columns..., text, spans, items); spans are word ranges found so far.

    `alone`: the benchmark has no other part, so that a cleaned text can be searched again at once.
    """

    def shard(texts: pa.Array, spans: list, items: list) -> tuple[list, list, list, list, list]:
        p: Phrases = phrases.value
        data, offs = utf8(texts)
        low = LOWER_LUT[data]
        s, e, first = words(low, offs, ALNUM_WORDS)
        begin, size, phrase = p.occurrences(p.symbols(word_hashes(low, s, e)), first)
        row = np.searchsorted(first, begin, "right") - 1
        pieces = [np.stack([begin - first[row], size], 1)] + [np.frombuffer(x, np.int64).reshape(-1, 2) for x in spans if x]
        rows = np.concatenate([row, *[np.full(len(x) // 16, i) for i, x in enumerate(spans) if x]]).astype(np.int64)
        found = np.concatenate(pieces)
        names = [set(x or ()) for x in items]
        if not clean:
            for r, ph in np.unique(np.stack([row, phrase], 1), axis=0):
                names[r].update(p.items[p.items_at[ph] : p.items_at[ph + 1]])
        step = np.zeros(len(s) + 1, np.int64)
        np.add.at(step, first[rows] + found[:, 0], 1)
        np.add.at(step, first[rows] + found[:, 0] + found[:, 1], -1)
        hit = np.cumsum(step)[:-1] > 0
        n_words, n_hit = np.diff(first), np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
        kept_spans = [None] * len(texts)
        if not final:
            order = np.argsort(rows, kind="stable")
            at = np.flatnonzero(np.diff(rows[order], prepend=-1))
            for own in np.split(order, at[1:]) if len(order) else ():
                kept_spans[rows[own[0]]] = found[own].tobytes()
        cleaned = texts.to_pylist() if clean and final else []
        if cleaned:
            for r in np.flatnonzero(n_hit):
                h = np.concatenate([[False], hit[first[r] : first[r + 1]], [False]])
                b, f = np.flatnonzero(h[1:] & ~h[:-1]) + first[r], np.flatnonzero(h[:-1] & ~h[1:]) - 1 + first[r]
                raw = data[offs[r] : offs[r + 1]].tobytes()
                edges = [0, *np.stack([s[b] - offs[r], e[f] - offs[r]], 1).ravel().tolist(), len(raw)]
                cleaned[r] = b"\n".join(raw[x:y].strip() for x, y in zip(edges[::2], edges[1::2], strict=True)).strip().decode()
            if alone and (cut_rows := np.flatnonzero(n_hit)).size:  # words that a cut has brought together can make a window
                again = shard(pa.array([cleaned[r] for r in cut_rows], pa.string()), [None] * len(cut_rows), [None] * len(cut_rows))[4]
                for r, text in zip(cut_rows, again, strict=True):
                    cleaned[r] = text
        return n_words.tolist(), n_hit.tolist(), kept_spans, [sorted(x) for x in names], cleaned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 3)
            _, offs = utf8(texts)
            parts = [shard(texts.slice(lo, hi - lo), batch.column(batch.num_columns - 2).slice(lo, hi - lo).to_pylist(), batch.column(batch.num_columns - 1).slice(lo, hi - lo).to_pylist()) for lo, hi in slices(offs, SHARD_BYTES)]
            n_words, n_hit, spans, items, cleaned = ([x for part in parts for x in part[k]] for k in range(5))
            own = batch.columns[:-3]
            if not final:
                out = [*own, texts, pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            elif clean:
                out = [*own, pa.array(cleaned, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
            else:
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                out = [*own, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=[str(k) for k in range(len(out))])

    return run


def _pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, text, n): items in pieces of at most PIECE_WORDS window starts, so that no row is longer than a piece."""
    lower = F.translate(F.coalesce(text_col, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("w"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE_WORDS)))
    pieces = rows.filter(F.size("w") > 0).withColumn("at", at).select("item", F.slice("w", F.col("at") + 1, PIECE_WORDS + window - 1).alias("w"))
    return pieces.select("item", F.array_join("w", " ").alias("text"), F.size("w").alias("n"))


def _parts(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> tuple[int, Callable[[], Iterator[Phrases]]]:
    """The number of parts of bounded size, and the parts, one on the driver at a time."""
    rows = _pieces(benchmark, window, id_col, text_col)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 + int(total) // PART_WORDS

    def each() -> Iterator[Phrases]:
        for k in range(parts):
            mine = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
            yield Phrases([(r.item, r.text) for r in mine.select("item", "text").collect()], window)

    return parts, each


def _run(docs: DataFrame, benchmark: DataFrame, window: int, columns: list[str], text_col: str, item_col: str, item_text_col: str, clean: bool) -> DataFrame:
    """The columns of docs as c0, c1, ... with what the search gives.

    With several parts, texts that a cut has changed are searched again for all parts, until no window is left in any.
    """
    spark = docs.sparkSession
    inner = [f"c{k}" for k in range(len(columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, inner, strict=True)], F.col(text_col).alias("text"))
    own = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in inner]
    n, parts = _parts(benchmark, window, item_col, item_text_col)
    tail = "text string, n_words long, n_hit long" if clean else "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"

    def searched(rows: DataFrame) -> DataFrame:
        state, last = rows.select(*inner, "text", F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items")), None
        for part in parts():
            if last is not None:
                state = cut(state.mapInArrow(_search(last, window, False, clean, False), ", ".join([*own, "text string, spans binary, items array<string>"])))
            last = spark.sparkContext.broadcast(part)
        return state.mapInArrow(_search(last, window, True, clean, n == 1), ", ".join([*own, tail]))

    if not clean or n == 1:
        return searched(rows)
    out, left = None, rows
    while out is None or not left.isEmpty():  # each round takes words out of every row that it passes on
        found = cut(searched(left))
        left, done = found.filter("n_hit > 0").select(*inner, "text"), found.filter("n_hit = 0")
        out = done if out is None else out.union(done)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, items (sorted ids), contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters after A-Z are lower-cased. A window is `window`
    consecutive words of an item, or a shorter item's whole sequence; a word inside any occurrence of a window is hit. Null and
    wordless texts have no words; items without words have no windows; a null item id is searched for but not listed.
    Repeated rows are judged each; empty tables give no rows or no hits; other columns are ignored. Texts and items of any
    length are searched whole; ids may be of any type.
    """
    out = _run(docs, benchmark, window, [id_col], text_col, item_col, item_text_col, False)
    return out.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with every hit span cut from the text, merged where spans overlap or touch; what remains is joined by line breaks.

    No window of any item is left, also none of words that a cut has brought together. Columns and rows stay, also rows whose
    text becomes empty; texts without a hit, null ones among them, stay as they are. docs may have columns of any names.
    """
    columns = [c for c in docs.columns if c != text_col]
    out = _run(docs, benchmark, window, columns, text_col, item_col, item_text_col, True)
    return out.select(*[F.col("text" if c == text_col else f"c{columns.index(c)}").alias(c) for c in docs.columns])
