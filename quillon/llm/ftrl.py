"""Quality classifier: hashed word n-gram logistic regression, fitted by
follow-the-regularised-leader updates and scored as sparse dot products.

Words are the whitespace runs of the lower-cased text (ASCII letters); words, word
pairs and pairs of word shapes (which see junk made of rare words) are hashed into 2^18 weights.  A document is the unit vector of
its damped counts, so length does not decide its score.

Scale: scoring is one pass without a shuffle; the weights (1 MB, fixed) go to
the tasks with the code.  The fit reads at most ``fit_rows`` labelled rows: their
hashed counts are made by the executors, and the sequential updates run on the
driver, where a text counts by its distinct features only.

Edge cases: null and empty texts get the score of the bias alone; without labels
of both kinds every score is near the only label (0.5 without any); repeated
rows each get a row; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.samples import labelled

BITS, FIT_ROWS, EPOCHS = 18, 3000, 6
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


#: Kinds of bytes: lower-case letters (and all beyond ASCII), capitals, digits, white space; the others are their own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123], _KIND[128:], _KIND[65:91], _KIND[48:58] = 97, 97, 65, 48


def shapes(part: K.Slice, w: K.Words) -> np.ndarray:
    """A hash of each word's shape: the kinds of its bytes, runs of a kind as one ("Hello!!" is Aa!)."""
    kind = _KIND[part.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[w.start] = True
    count = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(new, out=count[1:])
    return K.hashes(kind[new], count[w.start], count[w.end])


def features(part: K.Slice, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each non-zero of a slice's document vectors, ordered by row and feature.

    The n-grams are words, pairs of words and pairs of shapes; a word that repeats the one before it counts as one more.
    """
    w = K.words(part, fold=_FOLD)
    same = np.flatnonzero(w.row[:-1] == w.row[1:]) if len(w.row) > 1 else np.zeros(0, np.int64)
    again = same[w.hash[same] == w.hash[same + 1]]
    with np.errstate(over="ignore"):
        found = np.concatenate([w.hash, K.grams(w.hash, 2)[same], K.mix(K.grams(shapes(part, w), 2)[same] + K.U64(1)), np.full(len(again), 0x5DEECE66D00B1257, K.U64)])
    row = np.concatenate([w.row, w.row[same], w.row[same], w.row[again]])
    key, times = np.unique(row.astype(np.int64) << bits | (found >> K.U64(64 - bits)).astype(np.int64), return_counts=True)
    row, value = key >> bits, 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value * value, len(part)))
    return row, key & ((1 << bits) - 1), value / norm[row]


class Ftrl:
    """FTRL-proximal state: per weight, z and n; the weights follow from them."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, seed: int = 10) -> np.ndarray:
    """Weights, with the bias last.  The rarer label weighs as much in sum as a fifth of the rows at least."""
    size = 1 << bits
    model = Ftrl(size + 1)
    rng, share = np.random.default_rng(seed), labels.mean()
    heavy = {1: max(1.0, 0.2 / max(share, 1e-9)), 0: max(1.0, 0.2 / max(1 - share, 1e-9))}
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, x = docs[i]
            model.update(np.append(at, size), np.append(x, 1.0), float(labels[i]), heavy[int(labels[i])])
    return model.weights().astype(np.float32)


def gather(docs: DataFrame, labels: DataFrame, target: str, fit_rows: int, where: Column | None = None, bits: int = BITS) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The vectors (features, values) and targets (whole numbers) of a bounded sample of labelled rows, ordered by id."""
    sample = labelled(docs, labels, target, fit_rows, where).withColumn("label", F.col(target).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1)):
                row, at, value = features(part, bits)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), batch.column(2).slice(part.first, len(part)), *lists], names=["doc_id", "label", "at", "value"])

    rows = sample.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "label").mapInArrow(run, "doc_id long, label int, at array<int>, value array<float>").toArrow()
    ids, y, vectors = rows["doc_id"].to_numpy(), rows["label"].to_numpy(), []
    for batch in rows.to_batches():  # without copies
        at, value = batch.column("at"), batch.column("value")
        ends, at, value = at.offsets.to_numpy(), at.values.to_numpy(), value.values.to_numpy()
        vectors += [(at[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    # repeated ids tie; their vectors and labels decide nothing then but the order of equal updates
    order = np.lexsort((np.array([len(v[0]) for v in vectors]), ids))
    return [vectors[i] for i in order], y[order]


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, target: str = "quality", fit_rows: int = FIT_ROWS, bits: int = BITS) -> np.ndarray:
    vectors, y = gather(docs, labels.withColumn(target, (F.col(target) > 0).cast("int")), target, fit_rows, where, bits)
    out = np.zeros((1 << bits) + 1, np.float32)
    if not len(y) or y.min() == y.max():
        out[-1] = 0 if not len(y) else 30 if y[0] else -30
        return out
    return train(vectors, y, bits)


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score, the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1)):
                row, at, value = features(part, bits)
                dot = np.bincount(row, weights[at] * value, len(part)) + weights[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(1 / (1 + np.exp(-dot)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def held_out(column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id is not held out (and no label is found by it)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.7 or more); fitted on rows that aren't held out."""
    weights = fit(docs, labels, ~held_out(), fit_rows=fit_rows)
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
