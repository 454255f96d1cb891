"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives each document posteriors over the
domains, so a document is partly of each.  Its rate r >= 0 says how often it is
taken.  Rates minimise the squared gaps between the expected domain token totals
sum_d r_d tokens_d p_dk and their targets, each over the domain's present total or
target (so that small domains are fitted as large ones are), and of such rates are those nearest
to 1 (their distance counts ``NEAR`` times the gaps).  These are r_d = max(0, 1 - sum_k p_dk x_k) with one
number x_k per domain, found by Newton steps on the dual, which is concave, with
halved steps where a whole one doesn't ascend.  Steps end when every total is within ``CLOSE`` of
its own target, or, where the targets can't be met, at the least squares; the log
tells which totals the returned rates reach.

The texts are read once: rows go to a table in the shared folder with their posteriors.
Each step is one distributed sum of K (K + 1) + 1 numbers over it, and the final rates are an
expression of its columns.  Tokens are the ids of a vocabulary file, or
white-space words where none is given.

Copies are the whole part of rate plus a hashed uniform number, so totals match in
expectation; rates stay as fitted, but for rounding (``ROUNDING``) at whole numbers.

Edge cases: null and empty texts have no tokens, and the rate of their posteriors;
domains that no label has keep a total of zero; without labels all domains are equally
likely; repeated rows draw alike; other columns are kept (in
``mix``, but for those named as its own); an empty table gives an
empty table.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import ftrl
from quillon.llm import kernels as K
from quillon.llm.shared import cut
from quillon.llm.tokens import units

FIT_ROWS, STEPS, CLOSE, NEAR, ROUNDING = 3000, 400, 2e-3, 1e-6, 1e-9
_log = logging.getLogger(__name__)


@dataclass
class Domains:
    """One weight vector per domain, with the bias last."""

    names: list[str]
    weights: np.ndarray

    def posteriors(self, part: K.Slice) -> np.ndarray:
        """Rows x domains."""
        row, at, value = ftrl.features(part)
        logits = np.column_stack([np.bincount(row, w[at] * value, len(part)) + w[-1] for w in self.weights])
        odds = np.exp(np.clip(logits, -30, 30))
        return odds / odds.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, names: list[str], fit_rows: int = FIT_ROWS) -> Domains:
    """labels: doc_id and domain (one of names)."""
    code = F.array_position(F.lit(names), F.col("domain")) - 1
    vectors, y = ftrl.gather(docs, labels.select("doc_id", F.when(code >= 0, code).alias("code")), "code", fit_rows)
    out = np.zeros((len(names), (1 << ftrl.BITS) + 1), np.float32)
    for k in range(len(names)):
        own = (y == k).astype(int)
        if len(own) and 0 < own.sum() < len(own):
            out[k] = ftrl.train(vectors, own, seed=3 + k)
        elif len(own):
            out[k, -1] = 30 if own[0] else -30
    return Domains(names, out)


@dataclass
class Descent:
    """What a domain's share of a document takes from its rate; any document's rate follows from it."""

    less: np.ndarray

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0, 1 - p @ self.less)


def solve(table: DataFrame, targets: np.ndarray, steps: int = STEPS) -> tuple[Descent, np.ndarray]:
    """table: tokens and p.  targets: token totals per domain.  Returns the descent and the totals it reaches."""
    n = len(targets)

    def sums(less: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals, their change with less, and the sum of tokens times squared rates."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n * (n + 1) + 1)
            for batch in batches:
                p, t = batch.column(1).flatten().to_numpy().reshape(-1, n), batch.column(0).to_numpy().astype(float)
                r = Descent(less).rates(p)
                total += np.concatenate([(r * t) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel(), [(r * r * t).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["x"])

        found = table.select("tokens", "p").mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(n * (n + 1) + 1)
        for r in found:
            out[r["i"]] = r["x"]
        return out[:n], out[n:-1].reshape(n, n), out[-1]

    less = np.zeros(n)
    totals, slope, squares = sums(less)
    scale = np.maximum(np.maximum(totals, targets), 1e-12 * max(totals.sum(), 1.0))
    root = np.sqrt(scale)

    def rises(less: np.ndarray, totals: np.ndarray, squares: float) -> tuple[float, np.ndarray]:
        """The dual and its gradient."""
        return -squares / 2 - less @ targets - NEAR * (scale * less * less).sum() / 2, totals - targets - NEAR * scale * less

    met = lambda: bool((np.abs(totals - targets) <= CLOSE * targets).all())
    taken, height = 0, rises(less, totals, squares)
    while taken < steps and not met() and (np.abs(height[1]) > 1e-6 * scale).any():
        way = np.linalg.solve(slope / np.outer(root, root) + NEAR * np.eye(n), height[1] / root) / root
        part = 1.0
        while True:
            taken += 1
            totals, slope, squares = sums(less + part * way)
            higher = rises(less + part * way, totals, squares)
            if higher[0] >= height[0] + 1e-4 * part * (height[1] @ way) - 1e-12 * abs(height[0]) or part < 1e-9:
                break
            part /= 2
        less, height = less + part * way, higher
    _log.log(logging.INFO if met() else logging.WARNING, "mixing: %d steps reach token totals %s of targets %s", taken, totals.round(1).tolist(), targets.round(1).tolist())
    return Descent(less), totals


def _mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], fit_rows: int, relative: bool, path: str | None) -> DataFrame:
    """row (the other columns), text, tokens, p, rate and copies of every row."""
    names = list(targets)
    domains = fit_domains(docs, labels, names, fit_rows)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(c) for c in others)).alias("row"), F.col("text").cast("string").alias("text"))
    row = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = units(path).counts if path else lambda part: np.diff(K.words(part).bounds)
        for batch in batches:
            for part in K.slices(batch.column(1)):
                p, n = domains.posteriors(part), count(part)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * p.shape[1])
                own = [batch.column(c).slice(part.first, len(part)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=["row", "text", "tokens", "p"])

    table = cut(rows.mapInArrow(run, f"row {row}, text string, tokens long, p array<double>"), "posteriors")
    present = np.zeros(len(names))
    for r in table.select("tokens", F.posexplode("p").alias("k", "p")).groupBy("k").agg(F.sum(F.col("tokens") * F.col("p")).alias("n")).collect():
        present[r["k"]] = r["n"]
    wanted = np.array(list(targets.values())) * (present if relative else present.sum())
    descent, _ = solve(table, wanted)

    taken = sum((F.col("p")[k] * float(x) for k, x in enumerate(descent.less)), F.lit(0.0))
    rate = F.greatest(F.lit(0.0), 1 - taken)
    rate = F.when(F.abs(rate - F.round(rate)) <= ROUNDING, F.round(rate)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col("row.doc_id"), "text"), F.lit(1 << 30)) / float(1 << 30)
    return table.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


OWN = ("text", "tokens", "p", "rate", "copies")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], fit_rows: int = FIT_ROWS, relative: bool = False, path: str | None = None) -> DataFrame:
    """docs with tokens, p (in the order of targets), rate and copies; columns of these names give way to them.

    targets: per domain the expected token total wanted, as a share of all present
    tokens; with ``relative``, as a multiple of the domain's present total.
    path: the vocabulary file whose ids count as tokens.
    """
    return _mixed(docs, labels, targets, fit_rows, relative, path).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in OWN), *OWN)


def rows_mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], fit_rows: int = FIT_ROWS, relative: bool = False, path: str | None = None) -> DataFrame:
    """docs, with all their columns, each row as often as its copies say."""
    rows = _mixed(docs, labels, targets, fit_rows, relative, path).filter("copies > 0").select("row", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.select(*((F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def label_domains(labels: DataFrame) -> DataFrame:
    """The labelled table's domains: junk (quality 0), toxic, clean."""
    name = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality").isNotNull(), "clean")
    return labels.select("doc_id", name.alias("domain"))
