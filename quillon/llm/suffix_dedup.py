"""Suffix-array dedup: bytes covered by strings of ``LENGTH`` bytes that occur elsewhere.

A suffix array over a whole corpus can't be built in one place, and needn't: two
equal strings of 400 bytes have the same least 32-byte gram at the same place (their
*anchor*), so they meet when strings are grouped by their anchor's hash.
1. Each text is cut into excerpts: the bytes of all strings with the same anchor
   (a hundred or two starts, and the 399 bytes behind).  Only hashes leave the task.
2. Equal excerpts of an anchor are one, with their number and first place.  Excerpts
   that have no other of their anchor with the same 184 bytes before it, or after it, are
   done with: none of their strings occurs in another, since each has one of the two.
3. The bytes of what is left are fetched, and suffix arrays with the common prefixes of
   neighbours built over the excerpts of many anchors at a time.  In suffix order, ties in
   text order, the previous and the next smaller places give the longest previous factor
   (the longest match with earlier text) of each start, and the previous and next greater
   places the longest match with later text.
4. Starts with a factor of 400 bytes cover what is removed: with ``keep_first``
   those with a previous factor, which keeps the first copy; else those with any.
Copies of an excerpt beyond its first have their first as previous factor, so only
the first is in a suffix array.

Text order is (doc_id, place), null ids first.  An anchor with more than ``HOT``
different excerpts (a passage that very many texts share) is cut further
before step 3: into runs of starts, by the bytes that all strings of a run have in
common.  Equal strings stay together, and each round leaves few undecided.

Scale: texts are shuffled to fetch excerpts and once more to be cut; everything else is
hashes and places.  Counts are combined before shuffles, and joins on hot keys are left
to adaptive skew handling.

Edge cases: null counts as empty; texts under 400 bytes are never touched; matches
never cross texts; rows with equal id and text are one text in text order (all of them or none
keep a string); a character of which only some bytes are removed goes from ``text``
whole; a run of one character or a short period is one entry, since its excerpts recur within
400 bytes; other columns are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.groups import runs
from quillon.llm.shared import cut

LENGTH, GRAM = 400, 32
HOT, BATCH_BYTES, SHRINK = 1024, 1 << 16, 8


def anchors(part: K.Slice, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first and last start, anchor place and hash, hash of the excerpt, and hashes of what stands before and after the anchor, of each run of
    starts whose strings have the same anchor: the least gram of the string.  Grams are
    compared by a quick hash, since any choice that follows from the bytes will do.

    A string has half of what it is longer than its anchor before the anchor or after it, so equal
    ones agree in that; it is 0 where no string of the run has it.

    Equal strings have their anchors at the same place within them.  A string of
    ``length`` bytes has ``length - gram + 1`` grams, so a text has about two
    anchors in that many bytes.
    """
    n, w = len(part.data), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, *(empty.astype(K.U64),) * 4
    at = np.arange(n - gram + 1)
    h = K.Rolling(part.data).windows(gram)
    packed = (h & ~K.U64((1 << 28) - 1)) | at.astype(K.U64)  # ties go to the leftmost
    rows = -(-len(packed) // w)
    table = np.full((rows + 1) * w, np.iinfo(np.uint64).max, K.U64)
    table[: len(packed)] = packed
    table = table.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts])
    place = (least & K.U64((1 << 28) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(part)), part.ends - part.starts)[:starts]
    inside = np.arange(starts) + length <= part.ends[row]
    p = np.flatnonzero(inside)
    if not len(p):
        return empty, empty, empty, empty, *(empty.astype(K.U64),) * 4
    new = np.flatnonzero(np.append(True, (place[p][1:] != place[p][:-1]) | (p[1:] != p[:-1] + 1) | (row[p][1:] != row[p][:-1])))
    first, last = p[new], p[np.append(new[1:], len(p)) - 1]
    which = row[first]
    base = part.starts[which]
    prefix, anchor, half = K.Prefix(part.data), place[first], (length - gram) // 2
    before, after = np.zeros(len(first), K.U64), np.zeros(len(first), K.U64)
    i = np.flatnonzero(anchor - first >= half)
    before[i] = prefix.ranges(anchor[i] - half, anchor[i]) >> K.U64(33) | K.U64(1)
    i = np.flatnonzero(length - gram - (anchor - last) >= half)
    after[i] = prefix.ranges(anchor[i] + gram, anchor[i] + gram + half) >> K.U64(33) | K.U64(1)
    return which, first - base, last - base, anchor - base, prefix.ranges(anchor, anchor + gram), prefix.ranges(first, last + length), before, after


def entries(row: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, h: np.ndarray, x: np.ndarray, before: np.ndarray, after: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Row, h, x, s, m, o, second, final, times, before and after: equal excerpts of a row that follow within ``length`` bytes are one entry.

    s, second and final: where the first, second and last of them start (their strings cover all between);
    m: starts of an excerpt; o: how far the anchor lies behind its first start.
    """
    order = np.lexsort((first, x, h, row))
    r, a, k, z = row[order], first[order], h[order], x[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (z[1:] != z[:-1]) | (a[1:] - a[:-1] > length)
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(r)))
    one = order[at]
    return r[at], k[at], z[at], a[at], (last - first + 1)[one], (place - first)[one], a[np.minimum(at + 1, at + times - 1)], a[at + times - 1], times, before[one], after[one]


# --- suffix arrays --------------------------------------------------------------


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the starts in order of their first ``length`` bytes, ties in text order, and how many bytes each has in common with the one before it (at most ``length``).

    Prefix doubling; the ranks of all depths, kept, then give the common prefixes.
    """
    n = len(data)
    wide = np.zeros(n + length + 8, np.uint64)
    wide[:n] = data
    word = np.zeros(n + length, np.uint64)
    for j in range(8):
        word |= wide[j : j + n + length] << K.U64(56 - 8 * j)
    rank, depth = np.unique(word, return_inverse=True)[1].astype(np.uint64), 8
    levels = [(depth, rank.astype(np.uint32))]
    while 2 * depth <= length:
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - depth] = rank[depth:]
        rank = np.unique(rank << K.U64(32) | ahead, return_inverse=True)[1].astype(np.uint64)
        depth *= 2
        levels.append((depth, rank.astype(np.uint32)))
    key = rank[starts] << K.U64(32) | rank[starts + length - depth]
    order = np.argsort(key, kind="stable")
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        key, at = key[order], starts[order]
        lcp[1:][key[1:] == key[:-1]] = length
        todo = np.flatnonzero(key[1:] != key[:-1]) + 1
        a, b, same = at[todo - 1], at[todo], np.zeros(len(todo), np.int64)
        for depth, rank in reversed(levels):
            same += depth * ((rank[a + same] == rank[b + same]) & (same + depth <= length))
        rest = word[a + same] ^ word[b + same]
        lcp[todo] = np.minimum(same + sum((rest < K.U64(1 << 8 * j)).astype(np.int64) for j in range(1, 8)), length - 1)
    return order, lcp


def previous_smaller(values: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Per place the common prefix with the nearest place before it of a smaller value: the least lcp on the way there, 0 without one.

    All places look at once, each going from a place that is too great on to where that one looked.
    """
    near, least = np.arange(len(values)) - 1, lcp.copy()
    todo = np.arange(1, len(values))
    while len(todo := todo[near[todo] >= 0]) and len(todo := todo[values[near[todo]] > values[todo]]):
        past = near[todo]
        near[todo], least[todo] = near[past], np.minimum(least[todo], least[past])
    least[near < 0] = 0
    return least


def factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of starts in text order: the longest previous factor (the most bytes in common with an earlier start), and the longest following one.

    In suffix order the earlier starts with most in common are the nearest ones on either side: the
    previous and the next smaller place.  The later ones are the greater places.
    """
    back = np.append(0, lcp[:0:-1])
    earlier, later = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    earlier[order] = np.maximum(previous_smaller(order, lcp), previous_smaller(order[::-1], back)[::-1])
    later[order] = np.maximum(previous_smaller(-order, lcp), previous_smaller(-order[::-1], back)[::-1])
    return earlier, later


def _ranges(flags: np.ndarray) -> list[int]:
    """First and last of each run of true flags, in one list."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    out = edge.copy()
    out[1::2] -= 1
    return out.tolist()


def _matched(excerpts: DataFrame, length: int) -> DataFrame:
    """(h, x, whole, any, earlier): runs of starts of excerpts that match any other text, and earlier text.

    excerpts: h, x, n (how often it occurs), first (where), m (starts), bytes.
    """

    def solve(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).combine_chunks()
        h, x, n, m = (t[c].to_numpy() for c in ("h", "x", "n", "m"))
        texts = t["bytes"].to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum([0, *map(len, texts)])[:-1]
        ends = np.cumsum(m)
        starts = np.repeat(base - np.concatenate([[0], ends[:-1]]), m) + np.arange(ends[-1])
        earlier, later = (f >= length for f in factors(*suffix_array(data, starts, length)))
        some = [[], []]
        for lo, hi, times in zip((ends - m).tolist(), ends.tolist(), n.tolist(), strict=True):
            some[0].append([0, hi - lo - 1] if times > 1 else _ranges(earlier[lo:hi] | later[lo:hi]))
            some[1].append(_ranges(earlier[lo:hi]))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), *(pa.array(r, pa.list_(pa.int32())) for r in some)], names=["h", "x", "any", "earlier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in runs(batches, "h"):
            held.append(group)
            size += group["bytes"].nbytes
            if size >= BATCH_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    parts = int(excerpts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = excerpts.repartition(parts, "h").sortWithinPartitions("h", "first").select("h", "x", "n", "m", "bytes")
    return ordered.mapInArrow(run, "h long, x long, any array<int>, earlier array<int>")


def _parted(excerpts: DataFrame, length: int) -> DataFrame:
    """Each excerpt cut into runs of an ``SHRINK``-th of its starts: (h, x, at, ch, cx, n, first, m, bytes), grouped anew by what the strings of a run share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, x, m, span = (batch.column(c).to_pylist() for c in ("h", "x", "m", "span"))
            out: list[list] = [[] for _ in range(7)]
            for i, text in enumerate(batch.column("bytes").to_pylist()):
                prefix = K.Prefix(np.frombuffer(text, np.uint8))
                # runs begin at the same places before the anchor in all excerpts, since span counts from there
                size = max(1, span[i][1] // SHRINK)
                first = span[i][0]
                edges = sorted({0, m[i], *range((-first) % size, m[i], size)})
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    slot = (first + a) // size
                    low = slot * size - first  # where the slot's first start is, or would be
                    core = prefix.ranges(np.array([low + size - 1]), np.array([low + length]))[0]
                    ch = K.mix(np.array([core ^ K.mix(np.array([slot * 1024 + size], np.uint64))[0]]))[0]
                    cx = prefix.ranges(np.array([a]), np.array([b - 1 + length]))[0]
                    for column, value in zip(out, (i, a, int(ch.astype(np.int64)), int(cx.astype(np.int64)), b - a, text[a : b - 1 + length], [(first + a) % size, size]), strict=True):
                        column.append(value)
            row = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in ("h", "x", "n", "first")), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary()), pa.array(out[6], pa.list_(pa.int32()))],
                names=["h", "x", "n", "first", "at", "ch", "cx", "m", "bytes", "span"],
            )

    first = "first struct<doc_id: long, key: binary, s: int>"
    return excerpts.select("h", "x", "n", "first", "m", "bytes", "span").mapInArrow(run, f"h long, x long, n long, {first}, at int, ch long, cx long, m int, bytes binary, span array<int>")


def _resolved(excerpts: DataFrame, length: int, hot: int) -> DataFrame:
    """_matched of all excerpts, in which those of hot anchors are cut first."""
    sizes = excerpts.groupBy("h").agg(F.count("*").alias("c"))
    # tables of their own, here and below, so that joins can split a large group's partition
    hot_ones = cut(sizes.filter(F.col("c") > hot).select("h"), "hot")
    if not hot_ones.take(1):
        return _matched(excerpts, length)
    cool = _matched(excerpts.join(hot_ones, "h", "left_anti"), length)
    parted = cut(_parted(excerpts.join(hot_ones, "h"), length).withColumn("first", F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), (F.col("first.s") + F.col("at")).alias("s"))), "parted")
    pieces = parted.groupBy("ch", "cx").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.first("m").alias("m"), F.first("bytes").alias("bytes"), F.first("span").alias("span"))
    pieces = cut(pieces.select(F.col("ch").alias("h"), F.col("cx").alias("x"), "n", "first", "m", "bytes", "span"), "pieces")
    groups = cut(pieces.groupBy("h").agg(F.count("*").alias("c"), F.sum("n").alias("total")).filter("total > 1").select("h", "c"), "groups")
    alone = pieces.join(groups.filter("c = 1").select("h"), "h").select("h", "x", F.array(F.lit(0), F.col("m") - 1).alias("any"), F.array().cast("array<int>").alias("earlier"))
    several = cut(pieces.join(groups.filter("c > 1").select("h"), "h"), "several")
    solved = alone.unionByName(_resolved(several, length, hot))
    known = pieces.select(F.col("h").alias("ch"), F.col("x").alias("cx"), F.col("first").alias("piece_first"), F.col("m").alias("piece_m"))
    known = cut(known.join(solved.select(F.col("h").alias("ch"), F.col("x").alias("cx"), "any", "earlier"), ["ch", "cx"]), "known")
    back = parted.select("h", "x", "at", "ch", "cx", "first").join(known, ["ch", "cx"])
    earlier = F.when(F.col("first") == F.col("piece_first"), F.col("earlier")).otherwise(F.array(F.lit(0), F.col("piece_m") - 1))
    moved = back.select("h", "x", *(F.transform(c, lambda v: v + F.col("at")).alias(name) for c, name in ((F.col("any"), "any"), (earlier, "earlier"))))
    merged = moved.groupBy("h", "x").agg(F.flatten(F.collect_list("any")).alias("any"), F.flatten(F.collect_list("earlier")).alias("earlier"))
    return cool.unionByName(merged)


# --- the operator ---------------------------------------------------------------


def _keyed(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"), *more)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, key and the entries of each text."""
    kind = pa.struct([("h", pa.int64()), ("x", pa.int64()), *((c, pa.int32()) for c in ("s", "m", "o", "second", "final", "times", "before", "after"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(2)):
                row, h, x, *places = entries(*anchors(part, length), length=length)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                fields = [pa.array(h.astype(np.int64)), pa.array(x.astype(np.int64)), *(pa.array(v.astype(np.int32)) for v in places)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), batch.column(1).slice(part.first, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(kind)))],
                    names=["doc_id", "key", "at"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, key binary, at array<struct<h: long, x: long, s: int, m: int, o: int, second: int, final: int, times: int, before: int, after: int>>").filter(F.size("at") > 0)


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The excerpts in wanted (h, x, n, first, m, o), with their bytes and span (how far the anchor is left behind, and that at most)."""
    lists = wanted.groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key")).agg(F.collect_list(F.struct("h", "x", "n", "first", "m", "o")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, at = batch.column(0)[i].as_py().encode(), batch.column(1)[i].values
                s = pa.compute.struct_field(at.field("first"), "s").to_pylist()
                m, o = at.field("m").to_pylist(), at.field("o").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(at.field(c) for c in ("h", "x", "n", "first", "m")), pa.array([text[a : a + k - 1 + length] for a, k in zip(s, m, strict=True)], pa.binary()), pa.array([[length - v, length] for v in o], pa.list_(pa.int32()))],
                    names=["h", "x", "n", "first", "m", "bytes", "span"],
                )

    first = "first struct<doc_id: long, key: binary, s: int>"
    rows = _keyed(docs).join(lists, ["doc_id", "key"]).select("text", "at").mapInArrow(run, f"h long, x long, n long, {first}, m int, bytes binary, span array<int>")
    return rows


def repeated_spans(docs: DataFrame, keep_first: bool = True, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, key, spans) of the texts of which something is removed; spans: pairs of byte places, unmerged."""
    found = cut(_anchors(docs, length), "anchors")
    places = found.select("doc_id", "key", F.inline("at"))
    same = [F.first(c).alias(c) for c in ("m", "o", "before", "after")]
    excerpts = cut(places.groupBy("h", "x").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "key", "s")).alias("first"), *same), "excerpts")
    groups = cut(excerpts.groupBy("h").agg(F.count("*").alias("c"), F.sum("n").alias("total")).filter("total > 1").select("h", "c"), "groups")
    again = cut(excerpts.join(groups, "h"), "repeated")
    sides = again.filter("c > 1").select("h", "x", F.explode(F.array("before", F.negative("after"))).alias("side")).filter("side <> 0")
    shared = cut(sides.groupBy("h", "side").agg(F.count("*").alias("k")).filter("k > 1").select("h", "side"), "sides")
    partnered = cut(sides.join(shared, ["h", "side"]).select("h", "x").distinct(), "partnered")
    bytes_ = _fetched(docs, again.drop("c", "before", "after").join(partnered, ["h", "x"]), length).dropDuplicates(["h", "x"])
    solved = _resolved(cut(bytes_, "bytes"), length, hot)
    alone = again.filter("n > 1").join(partnered, ["h", "x"], "left_anti").select("h", "x", F.array(F.lit(0), F.col("m") - 1).alias("any"), F.array().cast("array<int>").alias("earlier"))
    ranges = cut(solved.unionByName(alone).filter(F.size("any") > 0), "ranges")
    if keep_first:
        ranges = ranges.join(again.select("h", "x", "first"), ["h", "x"])
    here = places.join(ranges, ["h", "x"])
    which, more = F.col("any"), F.array().cast("array<struct<a: int, b: int>>")
    if keep_first:
        kept = F.struct("doc_id", "key", "s") == F.col("first")
        which = F.when(kept, F.col("earlier")).otherwise(F.array(F.lit(0), F.col("m") - 1))
        later = F.struct(F.col("second").alias("a"), (F.col("final") + F.col("m") - 1 + length).alias("b"))
        more = F.when(kept & (F.col("times") > 1), F.array(later)).otherwise(more)
    # an excerpt that recurs matches as a whole, and what its places cover is one run
    end = F.when(kept, F.col("s")).otherwise(F.col("final")) if keep_first else F.col("final")
    pairs = F.transform(F.sequence(F.lit(0), F.size("r") - 2, F.lit(2)), lambda i: F.struct((F.col("s") + F.col("r")[i]).alias("a"), (end + F.col("r")[i + 1] + length).alias("b")))
    pairs = F.when(F.size("r") > 0, pairs).otherwise(F.array().cast("array<struct<a: int, b: int>>"))
    spans = here.withColumn("r", which).select("doc_id", "key", F.concat(pairs, more).alias("spans")).filter(F.size("spans") > 0)
    return spans.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the ranges a to b."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def _cleaned(docs: DataFrame, keep_first: bool, length: int, hot: int) -> DataFrame:
    """row (the other columns), text, n_bytes, n_removed, n_spans, spans and kept of every row."""
    others = [c for c in docs.columns if c != "text"]
    spans = repeated_spans(docs, keep_first, length, hot)
    joined = _keyed(docs, F.struct(*(F.col(c) for c in others)).alias("row")).join(spans, ["doc_id", "key"], "left").select("row", "text", "spans")
    row = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                out: list[list] = [[] for _ in range(6)]
                for text, spans in zip(piece.column(1).to_pylist(), piece.column(2), strict=True):
                    raw = text.encode()
                    if spans.is_valid:
                        a, b = merged(spans.values.field("a").to_numpy(), spans.values.field("b").to_numpy())
                        cuts = np.concatenate([[0], np.column_stack([a, b]).ravel(), [len(raw)]]).tolist()
                        kept = b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))
                        left = "".join(raw[i:j].decode(errors="ignore") for i, j in zip(cuts[::2], cuts[1::2], strict=True))
                        values = (left, len(raw), len(raw) - len(kept), len(a), np.column_stack([a, b]).astype(int).tolist(), kept)
                    else:
                        values = (text, len(raw), 0, 0, [], raw)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["row", "text", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(run, f"row {row}, text string, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary")


OWN = ("text", "n_bytes", "n_removed", "n_spans", "spans", "kept")


def suffix_dedup(docs: DataFrame, keep_first: bool = True, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The rows of docs with the text that is left, and n_bytes, n_removed, n_spans, spans (removed byte ranges) and kept (the bytes left).

    Columns of docs of these names give way to them.
    """
    return _cleaned(docs, keep_first, length, hot).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in OWN), *OWN)


def rows_cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, with all their columns, without later copies of long strings; rows of which nothing else is left go.  n_chars, if there, is set anew."""
    rows = _cleaned(docs, True, length, HOT).filter("n_removed = 0 or trim(text) <> ''")
    anew = {"text": F.col("text"), "n_chars": F.length("text")}
    return rows.select(*((anew[c].cast(docs.schema[c].dataType) if c in anew else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


#: What op2 returns, in one statement: every string of 400 bytes by itself.
SQL = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT id, doc_id, h, length(h) // 2 AS n FROM d),
s AS (SELECT id, unnest(range(n - 399)) AS p, h FROM b WHERE n >= 400),
k AS (SELECT id, p, md5_number(substr(h, 2 * p + 1, 800)) AS k FROM s),
t AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
r AS (SELECT id, p, p - row_number() OVER (PARTITION BY id ORDER BY p) AS g FROM k SEMI JOIN t USING (k)),
i AS (SELECT id, min(p) AS a, max(p) + 400 AS z FROM r GROUP BY id, g),
m AS (SELECT id, a, z, sum(CASE WHEN a > before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a) AS run
      FROM (SELECT *, coalesce(max(z) OVER (PARTITION BY id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM i)),
u AS (SELECT id, run, min(a) AS a, max(z) AS z, row_number() OVER (PARTITION BY id ORDER BY min(a)) AS o FROM m GROUP BY id, run),
x AS (SELECT id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS la, list(z ORDER BY a) AS lz FROM u GROUP BY id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(array_to_string(kept, ''))) AS kept_sha256,
       -- whole characters only: without bytes that continue one at a piece's start, or begin one at its end
       decode(unhex(array_to_string(list_transform(kept, lambda k: regexp_replace(regexp_replace(k, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '')), ''))) AS text
FROM (SELECT *, CASE WHEN x.id IS NULL THEN [h] ELSE list_transform(range(len(la) + 1), lambda j:
         substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE lz[j] END) + 1, 2 * ((CASE WHEN j = len(la) THEN n ELSE la[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE lz[j] END)))) END AS kept
      FROM b LEFT JOIN x USING (id))
"""
