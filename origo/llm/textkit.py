"""Vectorised word spans and polynomial hashes over Arrow text columns.

A word is a longest run of bytes other than space and 0x09 to 0x0D. Hashes are
Rabin-Karp polynomials modulo 2**64, taken from prefix sums and then mixed; the
hash of a window of words is the same kind of polynomial over word hashes.
Everything works on slices of some megabytes, so memory doesn't follow the
size of a partition; a single text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
U64 = np.uint64

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._grown(self.base, n), self._grown(self.inverse, n)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grown(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def _ranges(up: np.ndarray, down: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of values[start:end] for each pair."""
    prefix = np.empty(len(values) + 1, dtype=U64)
    prefix[0] = 0
    np.cumsum(values * up, out=prefix[1:])
    return (prefix[end] - prefix[start]) * down[start]


class Words:
    """The words of some texts that lie one after another in a buffer.

    `start`, `end`: byte places of each word; `first`: for each text the number
    of its first word, and at the end the number of all words.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        word = ~_SEPARATOR[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends = word
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.empty(0, dtype=U64)
        up, down = _BYTES.get(len(self.data) + 1)
        h = _ranges(up[:-1], down, _BYTE_VALUE[self.data], self.start, self.end)
        return mix(h + (self.end - self.start).astype(U64))

    def windows(self, n: int, hashes: np.ndarray, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n consecutive words of one text, by place,
        and for each text the number of its first window (and of all).

        With `short`, a text of fewer words, but one at least, has one window of
        all of them.
        """
        counts = self.counts
        per = np.maximum(counts - n + 1, 0)
        if short:
            per = np.where((per == 0) & (counts > 0), 1, per)
        first = np.concatenate(([0], np.cumsum(per)))
        if not first[-1]:
            return np.empty(0, dtype=U64), first
        of = np.repeat(np.arange(len(per)), per)
        at = np.arange(first[-1]) - first[of] + self.first[of]
        to = np.minimum(at + n, self.first[of + 1])
        up, down = _WORDS.get(len(hashes) + 1)
        return mix(_ranges(up[:-1], down, hashes, at, to) + (to - at).astype(U64)), first

    def text_of(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column without copying; null is empty."""
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive texts [a, b) of some megabytes together."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


def words_of(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(a, b, words of texts a to b) over a string column."""
    if not len(column):
        return
    data, bounds = utf8(column)
    for a, b in slices(bounds, most):
        yield a, b, Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


def binaries(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the bytes of parts[bounds[i]:bounds[i+1]]."""
    raw = np.ascontiguousarray(parts).view(np.uint8)
    offsets = (np.asarray(bounds, dtype=np.int64) * parts.dtype.itemsize).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return whole.cast(pa.binary())


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of data[start:end] for each pair, one after another, and their bounds."""
    bounds = np.concatenate(([0], np.cumsum(end - start)))
    return data[np.repeat(start - bounds[:-1], end - start) + np.arange(bounds[-1])], bounds


def same_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> bool:
    """Whether every slice has the bytes of the slice that `first` names for it."""
    size = end - start
    if (size != size[first]).any():
        return False
    own, _ = gathered(data, start, end)
    other, _ = gathered(data, start[first], end[first])
    return bool((own == other).all())


def grouped(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal slices: the first slice of each, and the group of each slice.

    `keys` are hashes (equal slices have equal ones). Every slice is compared with
    the first of its key; if any differs, slices are grouped by their bytes instead.
    """
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    if same_slices(data, start, end, first[group]):
        return first, group
    raw, seen = data.tobytes(), {}
    pairs = zip(keys.tolist(), start.tolist(), end.tolist())
    group = np.fromiter((seen.setdefault((k, raw[a:b]), len(seen)) for k, a, b in pairs), dtype=np.int64, count=len(keys))
    return np.unique(group, return_index=True)[1], group


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A string column of UTF-8 bytes that lie one after another."""
    raw, offsets = np.ascontiguousarray(data), np.asarray(bounds, dtype=np.int64)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())
