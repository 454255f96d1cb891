"""Vectorised text kernels shared by the llm operators.

Every kernel works on the bytes of one Arrow string column.  A column is cut
into slices of about ``SLICE_BYTES`` so that the temporary arrays stay small; a
slice never cuts a text.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so that its powers have inverses modulo 2^64

#: Bytes that separate words: space, and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(salt * 1_000_003)) * U64(_STEP)) | U64(1)


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_PRIME = U64((1 << 31) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, but for at most one such step too many."""
    return (x & _PRIME) + (x >> U64(31))


class _Lane:
    """One polynomial hash modulo the prime 2^31 - 1, where runs of equal structure don't cancel as they do modulo 2^64."""

    def __init__(self, salt: int):
        self.code = mix(_BYTE_CODE ^ U64(salt)) % _PRIME
        self.base = int(mix(np.array([salt], U64))[0] % _PRIME)
        self.known: dict[int, np.ndarray] = {}

    def _powers(self, base: int, n: int) -> np.ndarray:
        have = self.known.get(base)
        if have is None or len(have) < n:
            size, prime = max(n, SLICE_BYTES + 1), int(_PRIME)
            have, done, step = np.ones(size, np.uint32), 1, base
            while done < size:  # doubling: the next powers are those so far, times base^done
                more = min(done, size - done)
                have[done : done + more] = have[:more] * U64(step) % _PRIME
                done, step = 2 * done, step * step % prime
            if size == SLICE_BYTES + 1:  # those for a longer text aren't kept
                self.known[base] = have
        return have[:n]

    def sums(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the terms, each under 2^33, and the powers that undo a start's place."""
        n = len(data)
        out = np.zeros(n + 1, U64)
        terms = self.code[data]
        terms *= self._powers(self.base, n)
        np.cumsum(_fold(terms), out=out[1:])
        return out, self._powers(pow(self.base, -1, int(_PRIME)), n + 1)


_LANES = (_Lane(_STEP), _Lane(_BASE))


@dataclass
class Slice:
    """Consecutive rows of a column: their bytes, and where each row starts and ends."""

    first: int
    data: np.ndarray  # uint8
    starts: np.ndarray  # int64, one for each row
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a string column, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, len(column), i + 20_000)
        at = offsets[i : j + 1] - offsets[i]
        yield Slice(i, data[offsets[i] : offsets[j]], at[:-1], at[1:])
        i = j


class Prefix:
    """Hashes of any byte range of an array, in constant time each: two polynomials modulo 2^31 - 1 and the length."""

    def __init__(self, data: np.ndarray):
        self.lanes = [lane.sums(data) for lane in _LANES]

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        values = []
        for sums, back in self.lanes:
            h = _fold(_fold(sums[ends] - sums[starts]))
            h *= back[starts]
            h = _fold(_fold(h))
            values.append(h - _PRIME * (h >= _PRIME))
        with np.errstate(over="ignore"):
            return mix((values[0] << U64(31) | values[1]) ^ ((ends - starts).astype(U64) * U64(_STEP)))


#: Ranges beyond this many bytes are hashed by Prefix.
LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, which few bytes of the data need lie in: eight bytes at a time, mixed in between.

    Ranges of up to eight bytes have different hashes where they differ.
    """
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(U64) * U64(_STEP))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, h = starts[todo], size[todo], out[todo]
    while len(todo):
        h = mix(h ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        out[todo] = h
        more = np.flatnonzero(left > 8)
        todo, at, left, h = todo[more], at[more] + 8, left[more] - 8, h[more]
    todo = np.flatnonzero(size > LONG)
    if len(todo):
        out[todo] = Prefix(data).ranges(starts[todo], ends[todo])
    return out


class Rolling:
    """A quicker hash of ranges (a polynomial modulo 2^64), for choosing among them only: equal bytes hash alike, and others may too."""

    _POWERS: dict[int, np.ndarray] = {}

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        have = cls._POWERS.get(base)
        if have is None or len(have) < n:
            size = max(n, SLICE_BYTES + 1)
            with np.errstate(over="ignore"):
                have = np.full(size, base, U64)
                have[0] = 1
                have = np.multiply.accumulate(have)
            if size == SLICE_BYTES + 1:
                cls._POWERS[base] = have
        return have[:n]

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_CODE[data] * self._powers(_BASE, len(data)), out=self.sums[1:])
        self.back = self._powers(pow(_BASE, -1, 1 << 64), len(data) + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = self.sums[ends] - self.sums[starts]
            h *= self.back[starts]
            h ^= h >> U64(32)
            h *= U64(_STEP)
        return h

    def windows(self, size: int) -> np.ndarray:
        """ranges of every window of so many bytes."""
        with np.errstate(over="ignore"):
            h = self.sums[size:] - self.sums[:-size]
            h *= self.back[: len(h)]
            h ^= h >> U64(32)
            h *= U64(_STEP)
        return h


@dataclass
class Words:
    """Words of the rows of a slice, in order of place."""

    row: np.ndarray  # of the slice
    start: np.ndarray  # byte
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of row i: bounds[i] to bounds[i + 1]


def words(part: Slice, separator: np.ndarray = SPACE, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that aren't separators. fold: a table that maps bytes first."""
    data = fold[part.data] if fold is not None else part.data
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separator[data]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    edge = part.starts[(part.starts > 0) & (part.starts < n)]  # a word never crosses rows
    if len(edge):
        begins[edge] = inside[1:-1][edge]
        finishes[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    bounds = np.append(np.searchsorted(start, part.starts), len(start))
    row = np.repeat(np.arange(len(part)), np.diff(bounds))
    return Words(row, start, end, hashes(data, start, end), bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k values from each place; the last k - 1 places have none."""
    n = max(0, len(hashes) - k + 1)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, k):
            out = out * U64(_STEP) + hashes[i : i + n]
    return mix(out)


def occurrence(values: np.ndarray) -> np.ndarray:
    """How many earlier places hold the same value."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    s = values[order]
    new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
    return out


def order_min_hash(values: np.ndarray, multipliers: np.ndarray, length: int) -> np.ndarray:
    """Order MinHash: for each multiplier, the ``length`` k-mers whose
    occurrence-labelled hashes are least, put in text order and hashed as a tuple.

    values are the k-mer hashes in text order.  A text with fewer k-mers gives
    all of them; one without any gives zeros.
    """
    n = len(values)
    if not n:
        return np.zeros(len(multipliers), U64)
    with np.errstate(over="ignore"):
        x = mix(values + occurrence(values).astype(U64) * U64(_STEP))
        picked = min(length, n)
        best = np.empty((len(multipliers), picked), np.int64)
        for lo in range(0, len(multipliers), max(1, (1 << 18) // n)):
            m = multipliers[lo : lo + max(1, (1 << 18) // n)]
            table = (x[None, :] ^ (m[:, None] >> U64(7))) * m[:, None]
            rows = np.arange(len(m))
            for j in range(picked):
                at = table.argmin(axis=1)
                best[lo : lo + len(m), j] = at
                table[rows, at] = U64(0xFFFFFFFFFFFFFFFF)
        best.sort(axis=1)
        out = np.full(len(multipliers), picked, U64)
        for j in range(picked):
            out = mix(out * U64(_STEP) + x[best[:, j]])
    return out
