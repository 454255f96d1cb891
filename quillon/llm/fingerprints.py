"""Document fingerprints by Order MinHash.

A text's k-mers are its windows of three words, each numbered by how often it
occurred before.  For each of ``SLOTS`` hash functions the two least k-mers are
taken, put in text order and hashed as a pair.  Unlike plain MinHash, whose
slots see only which k-mers occur, these also see their order, so block moves
lower the likeness as edit distance does.  Two texts share a slot with about the
squared weighted Jaccard index (times the chance of equal order); the likeness
is the square root of the share of equal slots.

``fingerprints`` is one pass without a shuffle.  ``with_successor`` pairs each row
with the next of a total order: rows are dealt into spans of it, the first row of
each span goes to the span before as well, and each span is read once in
sorted batches, so no task holds more than a batch and one text.  Spans are blocks of ids
(at most ``SIDE`` squared, known to the driver), cut further by ids inside a block (``FINE`` at
most, computed by block) where blocks would be large, and ids with more rows than a block by ranges of
their texts' hashes.  So there are up to ``FINE`` times ``SIDE`` squared spans, 2^18, and lists sent to
the tasks are bounded by that.

Edge cases: texts without a word have the fingerprint of zeros and are alike to
each other only; a text of one or two words is one k-mer; null counts as empty;
rows with a null id come last; equal ids are ordered by their texts' hashes, and
rows equal in both, which nothing tells apart, lie in one span; columns other
than doc_id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import kernels as K

SLOTS, GRAM, PICKED = 48, 3, 2
_MULTIPLIERS = K.seeds(SLOTS, 9)
ROWS_A_RANGE, SIDE, FINE, PIECES = 512, 128, 16, 1 << 15


def sketches(part: K.Slice, gram: int = GRAM, picked: int = PICKED, multipliers: np.ndarray = _MULTIPLIERS) -> np.ndarray:
    """Rows x slots of 32-bit numbers."""
    w = K.words(part)
    out = np.zeros((len(part), len(multipliers)), np.uint32)
    for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True)):
        if a < b:
            out[i] = (K.order_min_hash(K.grams(w.hash[a:b], min(gram, b - a)), multipliers, picked) >> K.U64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray, picked: int = PICKED) -> np.ndarray:
    return np.mean(a == b, axis=1) ** (1 / picked)


def as_text(sketch: np.ndarray) -> list[str]:
    raw = sketch.astype(">u4").tobytes().hex()
    size = 8 * sketch.shape[1]
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(as_text(sketches(part)))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _block(cuts: list[int]) -> Column:
    """How many of the rising cuts lie above doc_id, so that block 0 holds the largest ids: the group of cuts first, then the place in it."""
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + SIDE] for i in range(0, len(cuts), SIDE)]
    up_to = lambda values: F.array_size(F.filter(values, lambda c: c <= F.col("doc_id")))
    longs = lambda values: F.lit(values).cast("array<long>")
    group = up_to(longs([g[0] for g in groups])) - 1
    below = F.when(group < 0, 0).otherwise(group * SIDE + up_to(F.get(F.array(*map(longs, groups)), F.greatest(group, F.lit(0)))))
    return (len(cuts) - below).cast("int")


def spanned(docs: DataFrame, rows_a_range: int) -> DataFrame:
    """docs (doc_id, known, key, ...) with span: numbers that rise with descending doc_id, known and key."""
    n = docs.count()
    blocks = max(1, min(-(-n // rows_a_range), SIDE * SIDE))
    at = [i / blocks for i in range(1, blocks)]
    found = docs.agg(F.percentile_approx("doc_id", at, 20 * blocks).alias("x")).first()["x"] or [] if at else []
    cuts = sorted(set(found))
    docs = docs.withColumn("block", _block(cuts))
    fine, fine_to = F.lit(0), min(FINE, -(-n // (rows_a_range * blocks)))
    if fine_to > 1:
        points = [i / fine_to for i in range(1, fine_to)]
        inside = docs.groupBy("block").agg(F.array_distinct(F.percentile_approx("doc_id", points, 50 * fine_to)).alias("inside"))
        docs = docs.join(F.broadcast(inside), "block")  # SIDE * SIDE rows of FINE numbers at most
        fine = F.array_size(F.filter("inside", lambda c: c > F.col("doc_id")))
    # an id that quantiles fell on is its block's least, and gets as many pieces as they'd have spans
    heavy = [(c, min(PIECES - 1, max(1, fine_to) * k)) for c, k in sorted(Counter(found).items()) if max(1, fine_to) * k > 1]
    piece = F.lit(0)
    if heavy:
        spark = docs.sparkSession
        docs = docs.join(F.broadcast(spark.createDataFrame(heavy, "doc_id long, pieces int")), "doc_id", "left")
        share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / float(1 << 32)
        # the same id as a null's stand-in: known rows come first
        pieces = F.when(F.col("known"), F.lit(0)).otherwise(F.col("pieces")) + F.floor((1 - share) * F.col("pieces"))
        piece = F.when(F.col("pieces").isNull(), 0).otherwise(1 + pieces)
    return docs.withColumn("span", ((F.col("block").cast("long") * FINE + fine) * (2 * PIECES + 1) + piece).cast("long")).drop("block", "inside", "pieces")


def dealt_in_ranges(docs: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(span, head, doc_id, known, text): rows in descending doc_id, cut into spans that lie whole in one partition and are sorted there.

    The row that follows a span's last row stands at its end once more, as its
    head; behind the last span that is the table's first row.  known is false where doc_id is null.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").cast("long").isNotNull().alias("known"), text.alias("text"), F.sha2(text, 256).alias("key"))
    docs = spanned(docs, rows_a_range)
    heads = docs.groupBy("span").agg(F.max(F.struct("doc_id", "known", "key")).alias("top"))
    heads = heads.select("span", "top.*").collect()  # one row for each of at most 2^18 spans, and pieces of ids
    heads = sorted(tuple(r) for r in heads)
    if not heads:
        return docs.select("span", F.lit(0).alias("head"), "doc_id", "known", "text").limit(0)
    spark = docs.sparkSession
    table = spark.createDataFrame([(*r, heads[i - 1][0]) for i, r in enumerate(heads)], "span long, doc_id long, known boolean, key string, goes_to long")
    first = docs.join(F.broadcast(table), ["span", "doc_id", "known", "key"])
    # equal copies of a head are one
    first = first.dropDuplicates(["span"]).select(F.col("goes_to").alias("span"), F.lit(1).alias("head"), "doc_id", "known", "text", "key")
    dealt = docs.select("span", F.lit(0).alias("head"), "doc_id", "known", "text", "key").unionByName(first)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several spans to a partition, so that hashing deals them evenly
    order = ["span", "head", F.desc("doc_id"), F.desc("known"), F.desc("key")]
    return dealt.repartition(max(parts, len(heads) // 4), "span").sortWithinPartitions(*order).drop("key")


def edited(text: str, following: str) -> str:
    """The text with its last third of characters replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness to it and to the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, whose successor is still to come
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                rows = pa.Table.from_batches([held, piece] if held is not None else [piece]).combine_chunks().to_batches()[0]
                held = rows.slice(rows.num_rows - 1)
                span, head = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                paired = np.flatnonzero((span[:-1] == span[1:]) & (head[:-1] == 0))
                if not len(paired):
                    continue
                texts = rows.column(4).to_pylist()
                own = np.concatenate([sketches(p) for p in K.slices(rows.column(4))])
                changed = [edited(texts[i], texts[i + 1]) for i in paired]
                other = np.concatenate([sketches(p) for p in K.slices(pa.array(changed, pa.large_string()))])
                ids, known = rows.column(2).to_numpy()[paired], rows.column(3).to_numpy(zero_copy_only=False)[paired]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=~known),
                        pa.array([len(texts[i]) for i in paired], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                        pa.array(as_text(own[paired])),
                        pa.array(as_text(other)),
                        pa.array(likeness(own[paired], other)),
                        pa.array(likeness(own[paired], own[paired + 1])),
                    ],
                    names=names,
                )

    return dealt_in_ranges(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
