"""Quality rules: an isolation forest on rule statistics.

Each document gets counts of words, symbols, repeated lines and repeated
three-word windows.  Fixed rules on these reject the worst (``base_failed``).
Of the rest, an isolation forest measures how few random splits isolate a
document's rule ratios; the path length beyond which a document counts as
anomalous is calibrated on labelled rows.

All labelled rows that pass the rules count, none is sampled: their least and
largest ratios give the box that the trees split, the good ones fall into the
trees' leaves, and the scores of good and bad ones give the threshold.

Scale: one pass without a shuffle gives the counts, a few numbers a document,
which are kept in the shared folder.  Three passes over the labelled rows' numbers
fit the forest; each task sums up what it has by leaf or by score, so the
driver gets at most ``TREES`` x 2^``DEPTH`` sums of leaves and twice ``GRID`` of scores.

Edge cases: a null or empty text has no words and fails the rules; without
labels of both kinds nothing beyond the rules is rejected; of several labels
of a document the least counts, for each of its rows; repeated rows each
get a row; columns other than doc_id and text are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.shared import cut

TREES, DEPTH, CLEAN_LOSS = 100, 12, 0.002
GRID = 1 << 16  # scores are multiples of 1/GRID, so that all different ones fit a small table
RATIOS = ("symbols", "capitals", "repeats", "lines", "points", "bare")
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " + ", ".join(f"r_{x} double" for x in RATIOS)

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_POINT = np.isin(np.arange(256), list(b"!?:;#*$%&|<>=~^_+-/\\@"))
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character
_WORDY = _UPPER | _LOWER | ((np.arange(256) >= 48) & (np.arange(256) <= 57)) | (np.arange(256) >= 128)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _lines(part: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines; a row of n line feeds has n + 1 lines."""
    feed = np.flatnonzero(part.data == 10)
    starts = np.concatenate([part.starts, feed + 1])
    ends = np.concatenate([feed, part.ends])
    rows = np.concatenate([np.arange(len(part)), np.searchsorted(part.ends, feed, side="right")])
    order = np.lexsort((starts, rows))
    at_end = np.lexsort((ends, np.concatenate([np.searchsorted(part.ends, feed, side="right"), np.arange(len(part))])))
    return starts[order], ends[at_end], rows[order]


def statistics(part: K.Slice) -> dict[str, np.ndarray]:
    """The counts of each row of a slice."""
    n, w, data = len(part), K.words(part), part.data
    n_words = np.diff(w.bounds)
    spaces = K.SPACE[data]
    out = {"n_words": n_words, "word_chars": _sums(_LEAD[data] & ~spaces, part.starts, part.ends), "n_symbols": _sums(_SYMBOL[data], part.starts, part.ends)}

    lo, hi, row = _lines(part)
    filled = _sums(~spaces, lo, hi) > 0
    lo, hi, row = lo[filled], hi[filled], row[filled]
    with np.errstate(over="ignore"):
        key = K.hashes(data, lo, hi) + K.mix(row.astype(K.U64)) if len(row) else np.zeros(0, K.U64)
    n_lines = np.bincount(row, minlength=n)
    out["n_dup_lines"] = np.bincount(row[K.occurrence(key) > 0], minlength=n)

    g = K.grams(w.hash, 3)
    inside = w.row[: len(g)] == w.row[2 : 2 + len(g)] if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        g = g[at] + K.mix(w.row[at].astype(K.U64))
    _, which, times = np.unique(g, return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    covered = np.zeros(len(w.row), bool)
    for i in range(3):
        covered[twice + i] = True
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=n)
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)

    letters = _sums((_UPPER | _LOWER)[data], part.starts, part.ends)
    bare = _sums(_WORDY[data], w.start, w.end) == 0
    words, some = np.maximum(n_words, 1), np.maximum(letters, 1)
    out["r_symbols"] = out["n_symbols"] / words
    out["r_capitals"] = _sums(_UPPER[data], part.starts, part.ends) / some
    out["r_repeats"] = out["n_repeat_words"] / words
    out["r_lines"] = out["n_dup_lines"] / np.maximum(n_lines, 1)
    out["r_points"] = _sums(_POINT[data], part.starts, part.ends) / words
    out["r_bare"] = np.bincount(w.row[bare], minlength=n) / words
    return out


@dataclass
class Forest:
    """Isolation trees in arrays: node 0 of a tree is its root; a leaf has feature -1 and its path length as value."""

    feature: np.ndarray  # trees x nodes
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    scale: float

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree, the leaf of each row."""
        rows = np.arange(len(x))
        for feature, value, left, right in zip(self.feature, self.value, self.left, self.right, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                open_ = f >= 0
                if not open_.any():
                    break
                below = x[rows, np.maximum(f, 0)] < value[node]
                node = np.where(open_, np.where(below, left[node], right[node]), node)
            yield node

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for rows that few splits isolate, less for common rows."""
        total = np.zeros(len(x))
        for value, node in zip(self.value, self.leaves(x), strict=True):
            total += value[node]
        return np.rint(np.exp2(-total / max(len(self.feature), 1) / self.scale) * GRID) / GRID

    def counts(self, x: np.ndarray) -> np.ndarray:
        """Rows by tree and leaf."""
        width = self.feature.shape[1]
        return np.array([np.bincount(node, minlength=width) for node in self.leaves(x)])


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m))


def draw(low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 6) -> Forest:
    """Whole trees without rows, children of node i at 2 i + 1 and 2 i + 2, with split points uniform over what is left of the box from low to high.

    The box, and not the rows of a node, gives the range: so a ratio that is the
    same in all reference rows still splits off rows that have another.
    """
    rng = np.random.default_rng(seed)
    wide, nodes = np.flatnonzero(high > low), np.arange((2 << depth) - 1)
    feature = np.full((trees, len(nodes)), -1, np.int64)
    value = np.zeros((trees, len(nodes)))
    if len(wide):
        lows, highs = (np.broadcast_to(e, (trees, 1, len(low))).astype(float) for e in (low, high))
        for level in range(depth):
            at = slice((1 << level) - 1, (2 << level) - 1)
            f = wide[rng.integers(0, len(wide), lows.shape[:2])]
            a, b = (np.take_along_axis(e, f[:, :, None], 2)[:, :, 0] for e in (lows, highs))
            feature[:, at], value[:, at] = f, a + rng.random(f.shape) * (b - a)
            own = np.arange(len(low)) == f[:, :, None]
            split = value[:, at][:, :, None]
            lows = np.stack([lows, np.where(own, split, lows)], 2).reshape(trees, -1, len(low))
            highs = np.stack([np.where(own, split, highs), highs], 2).reshape(trees, -1, len(low))
    inner = feature >= 0
    return Forest(feature, value, np.where(inner, 2 * nodes + 1, 0), np.where(inner, 2 * nodes + 2, 0), 1.0)


def weigh(drawn: Forest, counts: np.ndarray) -> Forest:
    """The drawn trees cut where no more than one of the counted rows is left; counts: rows by tree and leaf."""
    trees, size = drawn.feature.shape
    counts = counts.astype(np.int64)
    depth = int(size + 1).bit_length() - 2
    for level in range(depth - 1, -1, -1):
        at, under = slice((1 << level) - 1, (2 << level) - 1), counts[:, (2 << level) - 1 : (4 << level) - 1]
        counts[:, at] += under[:, ::2] + under[:, 1::2]
    inner = (drawn.feature >= 0) & (counts > 1)
    reached = np.ones((trees, size), bool)
    for level in range(depth):
        at, under = slice((1 << level) - 1, (2 << level) - 1), slice((2 << level) - 1, (4 << level) - 1)
        reached[:, under] = np.repeat(inner[:, at] & reached[:, at], 2, axis=1)
    levels = np.repeat(np.arange(depth + 1), 1 << np.arange(depth + 1))
    new = np.cumsum(reached, axis=1) - 1
    width = int(new.max()) + 1
    feature, left, right = (np.zeros((trees, width), np.int64) for _ in range(3))
    value = np.zeros((trees, width))
    tree, node = np.nonzero(reached)
    to, go = (tree, new[tree, node]), inner[tree, node]
    feature[to] = np.where(go, drawn.feature[tree, node], -1)
    value[to] = np.where(go, drawn.value[tree, node], levels[node] + expected_path(counts[tree, node]))
    left[to] = np.where(go, new[tree, drawn.left[tree, node]], 0)
    right[to] = np.where(go, new[tree, drawn.right[tree, node]], 0)
    return Forest(feature, value, left, right, max(float(expected_path(int(counts[:, 0].max()))), 1e-9))


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Forest:
    """The forest of the reference rows x."""
    drawn = draw(low, high)
    return weigh(drawn, drawn.counts(x))


def calibrate(score: np.ndarray, good: np.ndarray, times: np.ndarray | None = None, loss: float = CLEAN_LOSS) -> float:
    """The threshold above which most bad rows lie, while at most ``loss`` of the good ones do; in the middle of the gap there.

    times: how many rows each score stands for.
    """
    if good.all() or not good.any():
        return np.inf
    values, which = np.unique(score, return_inverse=True)
    times = np.ones(len(score)) if times is None else times
    up, bad = (np.bincount(which, times * part, len(values)) for part in (good, ~good))
    lost, caught = (1 - np.cumsum(n) / n.sum() for n in (up, bad))
    worth = np.where(lost <= loss, caught - lost, -1)
    best = int(worth.argmax())
    if worth[best] <= 0:
        return np.inf
    return float((values[best] + values[min(best + 1, len(values) - 1)]) / 2)


def _table(part: K.Slice, ids: pa.Array) -> tuple[list[pa.Array], dict[str, np.ndarray]]:
    s = statistics(part)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return [ids.slice(part.first, len(part)), *(pa.array(s[x].astype(np.int64)) for x in names), pa.array(s["base_failed"])], s


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and the ratios that the forest sees."""
    names = [x.split()[0] for x in STATS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1)):
                first, s = _table(part, batch.column(0))
                yield pa.RecordBatch.from_arrays([*first, *(pa.array(s[f"r_{x}"].astype(float)) for x in RATIOS)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STATS)


def _ratios(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f"r_{r}").to_numpy(zero_copy_only=False) for r in RATIOS]).astype(float)


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """A forest over the good ones of all labelled rows that pass the rules, and its calibrated threshold; stats: rule_statistics."""
    known = labels.select(F.col("doc_id").cast("long"), "quality").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    rows = cut(stats.filter("NOT base_failed").join(known, "doc_id").select("good", *(f"r_{r}" for r in RATIOS)), "judged")
    ends = rows.agg(F.count_if("good").alias("n"), *(f(f"r_{r}").alias(f"{f.__name__}_{r}") for f in (F.min, F.max) for r in RATIOS)).first()
    if ends["n"] < 2:
        return None, np.inf
    drawn = draw(*(np.array([ends[f"{f}_{r}"] for r in RATIOS]) for f in ("min", "max")))

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(drawn.feature.shape, np.int64)
        for batch in batches:
            n += drawn.counts(_ratios(batch))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], names=["leaf", "n"])

    counts = np.zeros(drawn.feature.size, np.int64)
    sums = rows.filter("good").mapInArrow(fall, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    counts[sums["leaf"]] = sums["n"]
    forest = weigh(drawn, counts.reshape(drawn.feature.shape))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_ratios(batch))), batch.column("good")], names=["score", "good"])

    scores = rows.mapInArrow(judge, "score double, good boolean").groupBy("score", "good").count().toPandas()
    return forest, calibrate(scores["score"].to_numpy(), scores["good"].to_numpy(bool), scores["count"].to_numpy(float))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its counts, base_failed, the anomaly score and whether it is kept."""
    stats = cut(rule_statistics(docs), "rules")
    forest, threshold = fit(stats, labels)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _ratios(batch)
            score = forest.score(x) if forest is not None else np.zeros(len(x))
            kept = ~batch.column("base_failed").to_numpy(zero_copy_only=False) & (score <= threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-2]), pa.array(score), pa.array(kept)], names=names)

    return stats.mapInArrow(run, schema)


def rows_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps."""
    forest, threshold = fit(rule_statistics(docs), labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(at)):
                s = statistics(part)
                x = np.column_stack([s[f"r_{r}"] for r in RATIOS]).astype(float)
                good = ~s["base_failed"] & ((forest.score(x) if forest is not None else np.zeros(len(x))) <= threshold)
                yield batch.slice(part.first, len(part)).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
