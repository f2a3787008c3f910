"""Quality classification by importance resampling.

Two generative models of hashed n-grams are counted: one of target text (documents labelled good), one of all raw text. A
document's log importance weight is the log ratio of its probabilities under both; adding Gumbel noise and keeping the k largest
samples k documents without replacement in proportion to their weights. k is the number of documents whose weight is above the
cut that separates the labelled good from the labelled bad best. Labelled rows are weighed for the cut by target models that
were counted without them, fold by fold.

N-grams are words, pairs of words, and pairs of word shapes. A word is a run of letters, digits and non-ASCII characters or a
run of punctuation; its shape is its kind, case and length class, and whether it repeats one of the two words before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, SPACE_WORDS, U64, cut, mix, sampled, slices, utf8, word_hashes

BITS = 16
BUCKETS = 1 << BITS
SMOOTHING = 0.5
#: Labelled rows that the target model and the cut are fitted on at most, chosen by a hash of their ids.
LABELLED = 20_000
#: Parts of the labelled rows; each is weighed by a target model of the other parts.
FOLDS = 5

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_KIND = np.where(ALNUM_WORDS | _UPPER, 1, 2).astype(np.uint8) * SPACE_WORDS.astype(np.uint8)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of the rows' texts."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offs] = True
    edges = np.flatnonzero(change)
    s, e = edges[:-1], edges[1:]
    solid = kind[s] > 0 if len(s) else np.zeros(0, bool)
    s, e = s[solid], e[solid]
    h = word_hashes(data, s, e)
    row = np.searchsorted(offs, s, "right") - 1
    same = lambda k: np.concatenate([np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (row[k:] == row[:-k])])
    upper = _UPPER[data[s]].astype(np.int64) + 2 * (_UPPER[data[e - 1]] & (e - s > 1)) if len(s) else np.zeros(0, np.int64)
    size = np.minimum(np.searchsorted([2, 3, 5, 9, 17, 33], e - s, "right"), 6)
    shape = (kind[s].astype(np.int64) * 4 + upper) * 32 + size * 4 + same(1) * 2 + (same(1) | same(2))
    shape = mix(shape.astype(U64) + U64(1))
    pair = row[1:] == row[:-1]
    words2, shapes2 = (mix(x[:-1] * U64(0x9E3779B97F4A7C15) + x[1:] + U64(seed))[pair] for x, seed in ((h, 7), (shape, 11)))
    return np.concatenate([row, row[1:][pair], row[1:][pair]]), (np.concatenate([h, words2, shapes2]) >> U64(64 - BITS)).astype(np.int64)


def _counts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts * BUCKETS, np.int64)
        for batch in batches:
            part = batch.column(0).to_numpy().astype(np.int64)
            data, offs = utf8(batch.column(1))
            for lo, hi in slices(offs):
                row, bucket = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                total += np.bincount(part[lo + row] * BUCKETS + bucket, minlength=parts * BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def ngram_totals(texts: DataFrame, parts: int = 1) -> np.ndarray:
    """Counts by part and bucket over all rows of a table of (part, text); their number is fixed."""
    rows = texts.mapInArrow(_counts(parts), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(parts * BUCKETS)
    out[rows.bucket.to_numpy()] = rows.n.to_numpy()
    return out.reshape(parts, BUCKETS)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    p = [(c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS) for c in (target, raw)]
    return np.log(p[0]) - np.log(p[1])


def _scores(ratio):
    """Adds the weights and numbers of n-grams of the last column's texts; the column before it names the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(batch.num_columns - 2).to_numpy().astype(np.int64)
            data, offs = utf8(batch.column(batch.num_columns - 1))
            weight, n = [], []
            for lo, hi in slices(offs):
                row, bucket = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                weight.append(np.bincount(row, ratio.value[part[lo + row], bucket], minlength=hi - lo))
                n.append(np.bincount(row, minlength=hi - lo))
            weight, n = (np.concatenate([np.zeros(0), *x]) for x in (weight, n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight), pa.array(n.astype(np.int64))], [*batch.schema.names, "_weight", "_ngrams"])

    return run


def _gumbel(key: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _score(docs: DataFrame, ratio, keep: list[str], id_col: str, text_col: str, seed: int, part: Column | None = None) -> DataFrame:
    """`keep` of docs as c0, c1, ... with _weight, _ngrams and _rank: weight and noise in millionths, as a whole number."""
    inner = [f"c{k}" for k in range(len(keep))]
    part = F.lit(0) if part is None else part
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, inner, strict=True)], F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).alias("_key"), part.cast("int").alias("_part"), F.col(text_col).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(_scores(ratio), f"{schema}, _weight double, _ngrams long")
    return out.withColumn("_rank", F.floor((F.col("_weight") + _gumbel(F.col("_key"), seed)) * 1e6))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> int | None:
    """The k-th largest whole number of a column, by histograms of ever narrower ranges; each brings `bins` counts to the driver."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = values.filter(F.col(column).between(low, high))
        counts = inside.groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).alias("bin")).count().collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if r["count"] >= k:
                break
            k -= r["count"]
        low, high = low + r.bin * width, min(high, low + (r.bin + 1) * width - 1)
    return int(low)


def best_cut(at: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the widest gap between scores that divides good from bad with the fewest errors; minus infinity without both.

    `at` are distinct scores in order, with the numbers of good and bad ones of each.
    """
    n_good, n_bad = good.sum(), bad.sum()
    if not n_good or not n_bad:
        return -np.inf
    errors = np.cumsum(good) + n_bad - np.cumsum(bad)  # cut just above at[k]
    best = np.flatnonzero(errors[:-1] == errors[:-1].min()) if len(at) > 1 else np.zeros(0, np.int64)
    if not len(best) or errors[:-1].min() >= min(n_good, n_bad):
        return -np.inf
    k = best[np.argmax(at[best + 1] - at[best])]
    return float((at[k] + at[k + 1]) / 2)


class Classifier:
    """Models fitted on docs and labels, and the noisy weight from which documents are kept."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, seed: int = 17):
        """docs: all raw text. labels: id, quality 0/1 and toxic 0/1; at most about `labelled` rows of it are used.

        Target text is of quality 1 and not toxic. Null labels and labels of ids that docs lacks say nothing; labels that
        contradict each other count as the worse. Without labels of both kinds every document is kept. Texts count whole,
        whatever their length; docs may have other columns of any names. Rows that repeat an id or have none draw the same
        noise where their ids (texts, where those are null) are equal, and ties at the k-th place all stay.
        """
        self.id_col, self.text_col, self.seed = id_col, text_col, seed
        sc = docs.sparkSession.sparkContext
        label = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("label_of"))
        label = label.agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).withColumn("h", F.xxhash64("label_of", F.lit(seed)))
        label = label.filter(sampled("h", F.lit(min(1.0, labelled / max(1, label.count())))))
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        sample = cut(texts.join(F.broadcast(label), F.col("id") == F.col("label_of")).select("id", "text", "q", "t", F.pmod(F.xxhash64("h"), F.lit(FOLDS)).cast("int").alias("fold")))
        raw = ngram_totals(docs.select(F.lit(0).alias("part"), F.col(text_col)))[0]
        folds = ngram_totals(sample.filter("q = 1 and t = 0").select("fold", "text"), FOLDS)
        target = folds.sum(0)
        none = np.zeros(BUCKETS)
        others = np.stack([log_ratio(target - f, raw) if (target - f).any() else none for f in folds])
        self.ratio = sc.broadcast((log_ratio(target, raw) if target.any() else none)[None])
        # a weight once with its numbers: copies of a text, under one id or many, are one row
        seen = _score(sample, sc.broadcast(others), ["q"], "id", "text", seed, F.col("fold")).groupBy("_weight").agg(F.count_if(F.col("c0") == 1).alias("good"), F.count_if(F.col("c0") == 0).alias("bad"))
        seen = seen.filter("good + bad > 0").orderBy("_weight").toPandas()
        self.cut = best_cut(*(seen[c].to_numpy() for c in ("_weight", "good", "bad")))
        self.scored = cut(_score(docs, self.ratio, [id_col], id_col, text_col, seed).select("c0", "_weight", "_ngrams", "_rank"))
        self.k = self.scored.filter(F.col("_weight") >= F.lit(self.cut)).count()
        self.threshold = kth_largest(self.scored, "_rank", self.k)

    def _kept(self) -> Column:
        return F.col("_rank") >= F.lit(self.threshold) if self.threshold is not None else F.lit(False)

    def report(self) -> DataFrame:
        """Per row: the id, log_weight, n_ngrams, kept. Null and empty texts weigh 0."""
        return self.scored.select(F.col("c0").alias(self.id_col), F.col("_weight").alias("log_weight"), F.col("_ngrams").alias("n_ngrams"), self._kept().alias("kept"))

    def kept(self, docs: DataFrame) -> DataFrame:
        """Those rows of docs that are kept, with their columns; scored again in place, so that no text is shuffled."""
        rows = _score(docs, self.ratio, docs.columns, self.id_col, self.text_col, self.seed).filter(self._kept())
        return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
