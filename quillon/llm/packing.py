"""Best-fit packing after Martello-Toth dominance reduction.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.  How
many pieces have each length is all that packing needs, and that table has at
most ``capacity`` rows however large the corpus.  On it the reduction fixes sets
that provably dominate every alternative for their largest piece: a piece that
fits with no other; a pair that fills a sequence; the largest partner, where only
one more piece fits; the best pair of partners, where two fit and the pair
dominates all others.  The rest is packed best-fit decreasing, many equal pieces
at a time.  The plan is a table of runs ("pieces 100 to 199 of length 37 go to
sequences 5000 to 5099 at offset 12"), again of bounded size, so pieces find
their place by a search in it.

Scale: one pass tokenizes and writes the piece table (without texts); lengths are
counted per task, and a piece's number among those of its length is its number in
its task plus what earlier tasks hold.  Nothing is shuffled but counts.

Edge cases: a null or empty text is one piece that holds the end id alone;
repeated rows each are packed; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.shared import cut

CAPACITY, END_ID = 4096, 1


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- the plan -----------------------------------------------------------------


@dataclass
class Sizes:
    """How many pieces of each length are left."""

    left: np.ndarray

    def largest(self, limit: int) -> int:
        """The largest length of at most ``limit`` that is left, or 0."""
        found = np.flatnonzero(self.left[: max(limit, 0) + 1])
        return int(found[-1]) if len(found) else 0

    def smallest(self, n: int) -> list[int]:
        """The n smallest lengths that are left, with repeats."""
        out: list[int] = []
        for size in np.flatnonzero(self.left)[:n]:
            out += [int(size)] * int(min(n - len(out), self.left[size]))
        return out


def _best_pair(sizes: Sizes, room: int) -> tuple[int, int]:
    """Two lengths that are left with the largest sum of at most ``room``."""
    some = np.flatnonzero(sizes.left)
    some = some[some < room]
    best = (0, 0)
    for a in some[::-1]:
        if 2 * a < sum(best):
            break
        sizes.left[a] -= 1
        b = sizes.largest(min(int(a), room - int(a)))
        sizes.left[a] += 1
        if b and a + b > sum(best):
            best = (int(a), b)
    return best


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets of lengths with how often each is fixed, and the counts that remain.

    From the largest length j down, with room = capacity - j:
    nothing fits: {j}.  A piece of exactly room: that pair, since any other
    company of j fits into that piece's place.  No two pieces fit together: the
    largest that fits, for the same reason.  No three fit: with a the largest that
    fits and (x, y) the pair of largest sum, {j, a} if a >= x + y, else {j, x, y}
    if x = a and y is the largest length of at most room / 2 or more, as then the
    larger of any other two fits in x's place and the smaller in y's.
    A set is fixed only where one of these holds.
    """
    sizes, fixed = Sizes(counts.astype(np.int64).copy()), []
    left = sizes.left

    def fix(*lengths: int) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        fixed.append((lengths, times))

    for j in range(capacity, 0, -1):
        room = capacity - j
        while left[j]:
            left[j] -= 1
            a, small = sizes.largest(room), sizes.smallest(3)
            choice: tuple[int, ...] | None = None
            if not a:
                choice = (j,)
            elif a == room or sum(small[:2]) > room or len(small) < 2:
                choice = (j, a)
            elif sum(small) > room or len(small) < 3:
                x, y = _best_pair(sizes, room)
                left[x] -= 1
                half = sizes.largest(room // 2)
                left[x] += 1
                choice = (j, a) if a >= x + y else (j, x, y) if x == a and y >= half else None
            left[j] += 1
            if choice is None:
                break
            # as often as it stays true: its lengths decide, and taking equal sets away leaves them the best until one runs out
            fix(*choice) if choice != (j,) else fix(j)
    return fixed, left


@dataclass
class Plan:
    """Runs: pieces first .. first + times - 1 of a length lie in sequences sequence .. at offset."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.first, self.length))
        return tuple(np.array(x, np.int64)[order] for x in (self.length, self.first, self.sequence, self.offset))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    fixed, left = reduce_by_dominance(counts, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = list(fixed)
    # best fit, decreasing: sequences with equal contents are one entry of the list of their room
    open_: dict[int, list[list]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, bool)
    for size in range(capacity, 0, -1):
        todo = int(left[size])
        while todo:
            fits = np.flatnonzero(rooms[size:])
            if not len(fits):
                each = capacity // size
                for n, times in ((each, todo // each), (todo % each, 1 if todo % each else 0)):
                    if times:
                        room = capacity - n * size
                        open_[room].append([(size,) * n, times])
                        rooms[room] = True
                break
            room = size + int(fits[0])
            contents, times = open_[room].pop()
            many = room // size  # so many more of this length go into one of these sequences
            use = min(times, todo // many)
            if use:
                open_[room - many * size].append([contents + (size,) * many, use])
                rooms[room - many * size] = True
                todo -= use * many
            else:
                use, n = 1, todo
                open_[room - n * size].append([contents + (size,) * n, 1])
                rooms[room - n * size] = True
                todo = 0
            if times > use:
                open_[room].append([contents, times - use])
            rooms[room] = bool(open_[room])
    patterns += [(tuple(c), t) for entries in open_.values() for c, t in entries]
    out, used = Plan(), np.zeros(capacity + 1, np.int64)
    for contents, times in patterns:
        at = 0
        for size in contents:
            out.length.append(size)
            out.first.append(int(used[size]))
            out.sequence.append(out.sequences)
            out.offset.append(at)
            used[size] += times
            at += size
        out.sequences += times
    return out


# --- the pieces ---------------------------------------------------------------


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task and the number in it of each piece among those of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.llm.tokens import units

        cache, task = units(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in K.slices(batch.column(1)):
                ids = [x + end for x in cache.ids([part.text(i) for i in range(len(part))])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(part)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                check = [zlib.crc32(memoryview(ids[r])[4 * s : 4 * (s + m)]) for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                number = K.occurrence(length) + seen[length]
                np.add.at(seen, length, 1)
                doc = batch.column(0).slice(part.first, len(part)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(check, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(number)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long")


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    from pyspark.sql import Window

    table = cut(pieces(docs, path or vocabulary(), capacity), "pieces")
    per_task = table.groupBy("length", "task").agg(F.max(F.col("number") + 1).alias("n"))
    # what earlier tasks hold of a length: tasks x lengths rows, not pieces
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    length, first, sequence, offset = plan(counts, capacity).table()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = length * (1 << 44) + first
        for batch in batches:
            size, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = table.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
