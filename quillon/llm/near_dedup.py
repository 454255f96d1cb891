"""MinHash near-dedup: Order MinHash candidates, verified by banded alignment.

A text's k-mers are its windows of five words (lower-cased ASCII letters), numbered by
occurrence.  Each of ``BANDS`` hash functions samples ``PICKED`` least k-mers and
keeps their text order; texts with an equal sample share a bucket.  Two texts are
linked if an alignment of their k-mer sequences matches at least 0.8 of the longer
one's: their edit similarity, L / max(n, m), which counts what stands in the same order.
At that similarity two texts of n k-mers have 1.2 n different ones and share a band with
C(0.8 n, 3) / C(1.2 n, 3): 0.30 for long texts, 0.25 for ten k-mers, 0.20 for five.  All
``BANDS`` miss with probability 8e-7, 8e-6 and 1.3e-4; a passage that stands twice in both texts
and is cut once in one lets k-mers change numbers, 0.22 and 5e-5.  Classes are the connected
components of the links.

Equal texts are one node.  Not all pairs of a bucket are made:
1. each member is aligned with its bucket's least member;
2. buckets that still span several classes are joined to families, and what is
   left of a family (its texts outside its largest class) is compared block by
   block, in memory, with all of it.  The number of k-mers in common, an upper bound of L, comes for a
   whole block from one matrix product; what it can't settle is aligned, likeliest first, and pairs that
   are in one class by then are skipped.
So the work grows with the members where they are alike, and no link between classes is lost.

Scale: texts are read twice, once for the samples and once for the aligned ones;
buckets hold keys only.  A first text that very many are aligned with is sent
once for each 256 of them; a family's blocks hold 256 texts, and its largest class is sent
once for each block of the rest.  Everything that is read twice is written to the
shared folder.

Edge cases: null counts as empty; equal texts, empty ones included, are one
class; a text of fewer than five words is a single k-mer; ids may repeat or be null (the
class id is the least id, null if there is none); other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.components import components
from quillon.llm.groups import runs
from quillon.llm.shared import cut, drop

GRAM, BANDS, PICKED, LIKE = 5, 40, 3, 0.8
BLOCK, SALT_ROWS, TABLE = 256, 256, 1 << 21
SHORT, SPARSE = 4096, 4  # alignments of longer sequences keep no table of masks; those with few matches go by them
_MULTIPLIERS = K.seeds(BANDS, 1)
_BAND_CODE = K.seeds(BANDS, 101)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def kmers(hashes: np.ndarray) -> np.ndarray:
    return K.grams(hashes, min(GRAM, len(hashes))) if len(hashes) else hashes


def sequences(column: pa.Array) -> list[np.ndarray]:
    """The k-mer hashes of each text, in order."""
    out = []
    for part in K.slices(column):
        w = K.words(part, fold=_FOLD)
        out += [kmers(w.hash[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return out


def needed(n: int, m: int, like: float = LIKE) -> int:
    """The least number of matches at which lengths n and m are alike."""
    return int(np.ceil(like * max(n, m) - 1e-9))


def _by_matches(x: list[int], places: dict[int, list[int]], up: int, down: int) -> int:
    """The longest common subsequence inside the band, match by match: work and memory grow with these."""
    ends: list[int] = []  # ends[k]: the least place in y at which k + 1 matches can end
    for i, c in enumerate(x):
        for j in reversed(places.get(c, ())):
            if i - down <= j <= i + up:
                k = bisect_left(ends, j)
                if k == len(ends):
                    ends.append(j)
                else:
                    ends[k] = j
    return len(ends)


def _by_bits(x: list[int], places: dict[int, list[int]], size: int, up: int, down: int) -> int:
    """The same by rows of bits over y (bit-parallel); of long ones the masks aren't kept, so memory is linear."""
    full = v = (1 << size) - 1
    masks: dict[int, int] = {}
    for i, c in enumerate(x):
        if c not in places:
            continue
        low = max(0, i - down)
        width = max(0, i + up + 1 - low)
        if size <= SHORT:
            if c not in masks:
                masks[c] = sum(1 << j for j in places[c])
            p = masks[c] & (((1 << width) - 1) << low)
        else:
            near = np.zeros(min(width, size - low) if low < size else 0, np.uint8)
            at = places[c]
            near[np.array(at[bisect_left(at, low) : bisect_left(at, low + len(near))], np.int64) - low] = 1
            p = int.from_bytes(np.packbits(near, bitorder="little").tobytes(), "little") << low
        u = v & p
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, like: float = LIKE) -> float:
    """The similarity of two sequences by banded alignment, or 0 if it is below ``like``.

    Any alignment with enough matches skips at most n - L of a and m - L of b, so
    it stays in a band of diagonals, and so does this one.  Equal ends are matched
    first; what is between goes by its matches if it is long and these are few, else by bits.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 1.0 if n == m else 0.0
    least = needed(n, m, like)
    if least > min(n, m):
        return 0.0
    same = min(n, m)
    differ = np.flatnonzero(a[:same] != b[:same])
    head = int(differ[0]) if len(differ) else same
    differ = np.flatnonzero(a[n - (same - head) :][::-1] != b[m - (same - head) :][::-1])
    tail = int(differ[0]) if len(differ) else same - head
    matched = head + tail
    x, y = a[head : n - tail], b[head : m - tail]
    if len(x) and len(y):
        values, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        in_x, in_y = np.bincount(at[: len(x)], minlength=len(values)), np.bincount(at[len(x) :], minlength=len(values))
        if matched + np.minimum(in_x, in_y).sum() < least:
            return 0.0
        up, down = m - least, n - least  # how far b may run ahead, and a
        places: dict[int, list[int]] = {}
        for j, c in enumerate(at[len(x) :].tolist()):
            places.setdefault(c, []).append(j)
        rows = at[: len(x)].tolist()
        few = len(y) > SHORT and int(in_x @ in_y) <= SPARSE * (len(x) + len(y))
        matched += _by_matches(rows, places, up, down) if few else _by_bits(rows, places, len(y), up, down)
    s = matched / max(n, m)
    return s if matched >= least else 0.0


def _samples(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and the buckets of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(2)):
                w = K.words(part, fold=_FOLD)
                bands = np.zeros((len(part), BANDS), np.int64)
                for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True)):
                    if a < b:
                        bands[i] = K.mix(K.order_min_hash(kmers(w.hash[a:b]), _MULTIPLIERS, PICKED) ^ _BAND_CODE).astype(np.int64)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS)
                ids = (batch.column(c).slice(part.first, len(part)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(ends, pa.array(bands.ravel()))], names=["doc_id", "key", "bands"])

    return _keyed(docs).mapInArrow(run, "doc_id long, key binary, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, alike) of pairs of keys (a, b)."""
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n_a")), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n_a") / SALT_ROWS)).cast("int"))
    sized = sized.select("a", "salt", "b")
    heads = sized.select("a", "salt").distinct().join(texts.withColumnRenamed("key", "a"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    rest = sized.join(texts.withColumnRenamed("key", "b"), "b").select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], names=["a", "b", "alike"])

        for batch in batches:
            out: list[list] = [[], [], []]
            a, b, seqs = batch.column(0).to_pylist(), batch.column(2).to_pylist(), sequences(batch.column(3))
            for x, y, s in zip(a, b, seqs, strict=True):
                if y is None:
                    current, first = x, s
                else:
                    assert current == x
                    out[0].append(x)
                    out[1].append(y)
                    out[2].append(aligned(first, s) > 0)
            yield done()

    both = heads.unionByName(rest)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, "a binary, b binary, alike boolean")


def in_common(sequences: list[np.ndarray]) -> np.ndarray:
    """How many k-mers each two sequences have in common, counting repeats."""
    n = len(sequences)
    labelled = [K.mix(s + K.occurrence(s).astype(K.U64) * K.U64(0x9E3779B97F4A7C15)) for s in sequences]
    row = np.repeat(np.arange(n), list(map(len, labelled)))
    _, column, times = np.unique(np.concatenate(labelled), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    names, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(1, TABLE // n)
    for lo in range(0, len(names), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        table = np.zeros((n, min(step, len(names) - lo)), np.float32)
        table[row[a:b], column[a:b] - lo] = 1
        out += table @ table.T
    return out


def links_across(keys: list[bytes], texts: pa.Array, classes: list[bytes], blocks: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links that join all alike texts of different classes (if there are two blocks: across them) to classes."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    seqs = sequences(texts)
    keys, seqs, classes, blocks = [keys[i] for i in order], [seqs[i] for i in order], [classes[i] for i in order], blocks[order]
    label = np.unique(np.array(classes, object), return_inverse=True)[1]
    n = np.array(list(map(len, seqs)))
    common = in_common(seqs)
    enough = np.ceil(LIKE * np.maximum(n[:, None], n[None, :]) - 1e-9)
    open_ = (common >= enough) & (label[:, None] != label[None, :])
    if blocks.min() != blocks.max():
        open_ &= blocks[:, None] != blocks[None, :]
    i, j = np.nonzero(np.triu(open_, 1))
    likely = np.argsort(-common[i, j] / (n[i] + n[j]), kind="stable")
    parent = list(range(int(label.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
        x, y = root(label[a]), root(label[b])
        if x != y and aligned(seqs[a], seqs[b]) > 0:
            parent[x] = y
            out.append((keys[a], keys[b]))
    return out


def _across(families: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within the families (family, key, component) that join different components."""
    sizes = families.groupBy("family", "component").agg(F.count("*").alias("n"))
    # a table of its own, so that the join below can split a large family's partition
    sizes = cut(sizes.groupBy("family").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("most")), "sizes")
    marked = families.join(sizes, "family").withColumn("big", (F.col("size") > BLOCK) & (F.col("component") == F.col("most.component")))
    n_big = F.when(F.col("size") > BLOCK, F.col("most.n")).otherwise(0)
    marked = marked.withColumn("rest", F.greatest(F.lit(1), F.ceil((F.col("size") - n_big) / BLOCK)).cast("int")).withColumn("bigs", F.ceil(n_big / BLOCK).cast("int"))
    code = F.xxhash64("key")
    marked = marked.withColumn("block", F.when(F.col("big"), F.col("rest") + F.pmod(code, F.greatest("bigs", F.lit(1)))).otherwise(F.pmod(code, F.col("rest"))).cast("int"))
    last = F.when(F.col("big"), F.col("rest")).otherwise(F.col("rest") + F.col("bigs")) - 1
    marked = marked.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("family", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "family", "p", "q"):
            t = group.combine_chunks()
            found = links_across(t["key"].to_pylist(), t["text"], t["component"].to_pylist(), t["block"].to_numpy()) if len(t) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])

    parts = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.join(texts, "key").repartition(parts, "family", "p", "q").sortWithinPartitions("family", "p", "q").mapInArrow(run, "a binary, b binary")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, first_id, n_copies, component) of every text."""
    rows = cut(_samples(docs), "samples")
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    nodes = cut(nodes, "nodes")
    buckets = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("last")).filter("pivot < last")
    members = cut(buckets.join(shared, "bucket").select("bucket", "key", "pivot"), "members")
    none = -(1 << 63)
    held = members.select("key").distinct().join(nodes.select("key", F.coalesce("first_id", F.lit(none)).alias("first_id")), "key")
    texts = _keyed(docs).withColumn("first_id", F.coalesce("doc_id", F.lit(none))).join(held, ["key", "first_id"], "left_semi")
    texts = cut(texts.groupBy("key").agg(F.first("text").alias("text")), "texts")

    def classed(df: DataFrame, of: DataFrame, name: str = "component") -> DataFrame:
        return df.join(of.select(F.col("node").alias("key"), F.col("component").alias(name)), "key", "left").withColumn(name, F.coalesce(name, "key"))

    pairs = members.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    links = _verify(pairs, texts).filter("alike").select("a", "b")
    labels = cut(components(links), "labels")

    marked = classed(members, labels)
    mixed = marked.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    mixed = cut(marked.join(mixed, "bucket").select("key", "pivot", "component"), "mixed")
    families = components(mixed.select(F.col("pivot").alias("a"), F.col("key").alias("b")).filter("a <> b").distinct())
    families = classed(mixed.select("key", "component").distinct(), families, "family")
    more = cut(_across(families, texts), "links")
    if more.take(1):
        labels = cut(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(more)), "labels")

    return rows.select("doc_id", "key"), classed(nodes.select("key", "first_id", "n_copies"), labels)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), n_class (documents in the class) and n_copies (of its text)."""
    rows, found = _classes(docs)
    of_class = found.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("n_copies").alias("n_class"))
    found = found.join(of_class, "component").select("key", "class_id", "n_class", "n_copies")
    return rows.join(found, "key").select("doc_id", "class_id", "n_class", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, reduced to one row of each class: that of least id, and of several such texts the least."""
    _, found = _classes(docs)
    keep = found.groupBy("component").agg(F.min(F.struct("first_id", "key")).alias("one")).select(F.col("one.key").alias("key"), F.coalesce("one.first_id", F.lit(-(1 << 63))).alias("first_id"))
    keyed = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("first_id"))
    return keyed.join(keep, ["key", "first_id"]).groupBy("key", "first_id").agg(F.first("row").alias("row")).select("row.*")
