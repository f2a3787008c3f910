"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed. Document frequencies cover all training documents; the weights are learned on a
bounded sample per language by follow-the-regularised-leader with an elastic net, and a temperature fitted on a part of the
sample that the weights have not seen makes the scores calibrated probabilities. One task learns from the sample, whose size
is bounded; the driver gets the finished weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled

BITS = 14
FEATURES = 1 << BITS
#: Characters that one working block of a task holds at most, unless a single text is longer.
BLOCK_CHARS, BLOCK_ROWS = 1_000_000, 64


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        t = t or ""
        if held and (size + len(t) > BLOCK_CHARS or len(held) == BLOCK_ROWS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and counts of the texts' hashed n-grams, by row, then feature."""
    encoded = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    c = np.concatenate([np.zeros(0, np.uint32), *encoded])
    row = np.repeat(np.arange(len(texts)), [len(x) for x in encoded])
    table = np.zeros(len(texts) * FEATURES, np.int64)
    h = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for n in range(1, 4):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0xC2B2AE35)
        whole = row[: len(h)] == row[n - 1 :][: len(h)]
        feature = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
        table += np.bincount((row[: len(h)] * FEATURES + feature)[whole], minlength=len(table))
    at = np.flatnonzero(table)
    return at >> BITS, at & (FEATURES - 1), table[at]


def tf_idf(row: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Values of unit length for each row."""
    v = np.log1p(count) * idf[feature]
    norm = np.sqrt(np.bincount(row, v * v, minlength=rows))
    return v / np.where(norm > 0, norm, 1)[row]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES + 1, np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for part in blocks(batch.column(0).to_pylist()):
            df[:FEATURES] += np.bincount(ngram_counts(part)[1], minlength=FEATURES)
    df[FEATURES] = n  # the number of documents
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["feature", "df"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for part in blocks(batch.column(1).to_pylist()):
            row, feature, count = ngram_counts(part)
            bounds = np.searchsorted(row, np.arange(len(part) + 1))
            out += [(feature[a:b].astype(np.int32).tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["lang", "part", "features", "counts"])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features and a bias, by language
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        row, feature, count = ngram_counts(texts)
        v = tf_idf(row, feature, count, self.idf, len(texts))
        z = np.stack([np.bincount(row, v * w[feature], minlength=len(texts)) for w in self.weights.T], 1) + self.weights[FEATURES]
        return softmax(z / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, passes: int, alpha: float, beta: float, l1: float, l2: float, together: int = 16) -> np.ndarray:
    """Weights (features and a bias, by class) after `passes` passes over rows of (features, values, class), `together` rows a step.

    Each coordinate's weight is the minimiser of the linearised losses so far plus elastic-net and proximal terms; weights whose
    summed gradient stays under l1 are zero.
    """
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at) -> np.ndarray:
        x = z[at]
        return np.where(np.abs(x) <= l1, 0.0, (np.sign(x) * l1 - x) / ((beta + np.sqrt(n[at])) / alpha + l2))

    steps = []
    for s in range(0, len(rows), together):
        some = rows[s : s + together]
        feature = np.concatenate([np.append(f, FEATURES) for f, _, _ in some])
        value = np.concatenate([np.append(v, 1.0) for _, v, _ in some])
        begin = np.cumsum([0, *[len(f) + 1 for f, _, _ in some[:-1]]])
        at, place = np.unique(feature, return_inverse=True)
        order = np.argsort(place, kind="stable")
        steps.append((at, place, value, begin, np.array([k for _, _, k in some]), order, np.searchsorted(place[order], np.arange(len(at)))))
    for _ in range(passes):
        for at, place, value, begin, label, order, first in steps:
            w = weights(at)
            error = softmax(np.add.reduceat(value[:, None] * w[place], begin))
            error[np.arange(len(label)), label] -= 1
            each = value[:, None] * np.repeat(error, np.diff(np.append(begin, len(value))), axis=0)
            g = np.add.reduceat(each[order], first)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda s: -np.log(np.maximum(softmax(z / np.exp(s))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learned(rows: list[tuple[str, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray, passes: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and temperature from (language, features, counts) in their order; every fifth row is kept for the temperature."""
    learn, check = [], []
    for k, (lang, feature, count) in enumerate(rows):
        (check if k % 5 == 4 else learn).append((feature, tf_idf(np.zeros(len(feature), np.int64), feature, count, idf, 1), languages.index(lang)))
    w = follow_the_leader(learn, len(languages), passes, alpha, beta, l1, l2)
    z = np.array([v @ w[f] + w[FEATURES] for f, v, _ in check]).reshape(-1, len(languages))
    return w, fit_temperature(z, np.array([y for _, _, y in check], np.int64))


def _fit(idf, languages: list[str], *how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        found.sort(key=lambda r: (r[1], r[0], r[2]))
        if found:
            rows = [(lang, np.frombuffer(feature, np.int32), np.frombuffer(count, np.int32)) for lang, _, feature, count in found]
            w, temperature = learned(rows, languages, idf.value, *how)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([temperature])], ["weights", "temperature"])

    return run


def _sample(rows: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """(lang, text, part) of about `per_language` different texts of each language in sizes; part puts them in an order of its own."""
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / max(n, 1)))]), F.col("lang"))
    sample = rows.filter(sampled("h", share)).groupBy("lang", "text").agg(F.min("h").alias("h"))
    return sample.select("lang", "text", F.pmod(F.xxhash64("h"), F.lit(1 << 30)).alias("part"))


def train(docs: DataFrame, per_language: int = 1500, most_languages: int | None = None, passes: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, lang_col: str = "lang", text_col: str = "text", order: Column | None = None) -> Model | None:
    """A model of docs' non-null languages; None without any. Null and letterless texts teach nothing.

    Document frequencies cover all rows. The weights see a sample of about `per_language` different texts of each language,
    chosen by a hash (`order`, of the text by default), a fifth of it kept for the temperature. Copies of a text are one in it,
    so that a frequent text neither outgrows the sample nor swamps the weights. Every value of `lang` is learned; the learning
    task and the model take about 0.4 MB a value. A caller who knows the column to be dirty may name `most_languages`, and gets
    the most frequent values, of equal ones the first by code point. Texts of any length count whole; other columns are ignored.
    Of languages equally probable for a text, the first by code point is predicted.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (order if order is not None else F.xxhash64(text_col)).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    number = F.count("*") if order is not None else F.approx_count_distinct("h", 0.02)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(number.alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages or (1 << 31) - 1).collect()}
    if not sizes:
        return None
    df = rows.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    frequency = np.zeros(FEATURES + 1)
    frequency[df.feature] = df.df
    idf = np.log((1 + frequency[FEATURES]) / (1 + frequency[:FEATURES])) + 1
    sample = _sample(rows, sizes, per_language)
    languages, sc = sorted(sizes), docs.sparkSession.sparkContext
    vectors = sample.mapInArrow(_vectors, "lang string, part long, features binary, counts binary").repartition(1)
    got = vectors.mapInArrow(_fit(sc.broadcast(idf), languages, passes, alpha, beta, l1, l2), "weights binary, temperature double").collect()
    if not got:
        return None
    return Model(languages, idf, np.frombuffer(got[0].weights).reshape(FEATURES + 1, len(languages)), got[0].temperature)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            lang, score = [], []
            for part in blocks(batch.column(batch.num_columns - 1).to_pylist()):
                p = m.probabilities(part)
                lang += [m.languages[k] for k in p.argmax(1)]
                score += p.max(1).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns `keep` of each row with lang_pred and score, the calibrated probability of it.

    Texts that are null or have no letter, and all texts where there is no model, are `und` with score 0. Rows may repeat, and
    kept columns may have any names but lang_pred and score. Texts of any length are judged whole.
    """
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]
    rows = docs.select(*own, F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(keep)]
    if model is None:
        return rows.select(*back, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kept = ", ".join(f"c{k} {rows.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(keep)))
    rows = rows.select(*[f"c{k}" for k in range(len(keep))], F.col("text").isNotNull().alias("has"), "text")
    out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"{kept}, has boolean, lang_pred string, score double")
    return out.select(*back, F.when(F.col("has"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("has"), F.col("score")).otherwise(0.0).alias("score"))
