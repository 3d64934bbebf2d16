"""Vectorised text primitives over Arrow string columns.

All functions work on the raw UTF-8 buffer of a column: one array of bytes for
many documents, with start and end offsets, so there is no Python loop over
words or characters. Hashes are polynomials over 64-bit integers, read off one
running sum, and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20          # text handled at once; one longer document is taken whole
SLICE_ROWS = 4095              # a row's place in its slice fits into 12 bits
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for the byte values in the given closed ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_SPACE = ~byte_class((0x09, 0x0D), (0x20, 0x20))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random 64-bit number for each byte value.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Texts:
    """Some consecutive documents of one Arrow column (null counts as empty)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        self._sum: np.ndarray | None = None
        self._check: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of member bytes inside each document: document, start, end."""
        inside = members[self.data]
        before = np.empty(len(inside) + 1, dtype=bool)
        before[0], before[1:] = False, inside
        full = self.starts[self.ends > self.starts]
        before[full] = False
        start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(inside), dtype=bool)
        after[:-1], after[-1:] = inside[1:], False
        after[self.ends[self.ends > self.starts] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        return np.searchsorted(self.starts, start, side="right") - 1, start, end

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of each byte range."""
        up, down = powers(len(self.data))
        if self._sum is None:
            data = LOWER[self.data] if lower else self.data
            self._sum = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self._sum[1:])
        h = (self._sum[end] - self._sum[start]) * down[start]
        return mix(h ^ (end - start).astype(np.uint64))

    def checks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Another 64-bit hash of each byte range, independent of ``hashes``: the numbers that
        stand for the byte values are random ones."""
        up, down = powers(len(self.data))
        if self._check is None:
            self._check = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[self.data] * up[:len(self.data)], out=self._check[1:])
        return mix((self._check[end] - self._check[start]) * down[start] ^ (end - start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES,
           rows: int = SLICE_ROWS) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) for consecutive rows of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), first + rows, n)
        base = offsets[first]
        yield first, Texts(data[base:offsets[last]], offsets[first:last] - base,
                           offsets[first + 1:last + 1] - base)
        first = last


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """One byte for each hash bucket that grows with its count, about 9 % of it a step."""
    return np.minimum(8 * np.log2(1 + counts.astype(np.float64)), 255).astype(np.uint8)


def by_rarity(doc: np.ndarray, key: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shingles (sorted 52-bit hashes), the rarest first.

    The low bits of a hash are its bucket. Shingles of one class keep the order of their
    hashes, so all documents put the shingles that they share in the same order.
    """
    rare = classes[(key & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64)
    both = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (rare << np.uint64(44)) | np.arange(len(key), dtype=np.uint64))
    return (both >> np.uint64(52)).astype(np.int64), key[(both & np.uint64((1 << 44) - 1)).astype(np.int64)]


def word_shingles(texts: Texts, size: int, members: np.ndarray = NOT_SPACE
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles, A-Z lower-cased: (document, 52-bit hash), sorted by both.

    A document with fewer than ``size`` words, but not none, has its whole
    sequence as its only shingle.
    """
    doc, start, end = texts.runs(members)
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    h = texts.hashes(start, end, lower=True)
    count = np.bincount(doc, minlength=len(texts))
    spread = np.uint64(0x100000001B3)
    acc = h[:max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        acc = acc * spread + h[k:len(h) - size + 1 + k]
    whole = doc[:len(acc)] == doc[size - 1:] if len(acc) else np.zeros(0, bool)
    docs, keys = [doc[:len(acc)][whole]], [acc[whole]]
    first = np.cumsum(count) - count
    for few in range(1, size):
        d = np.flatnonzero(count == few)
        if len(d):
            a = h[first[d]]
            for k in range(1, few):
                a = a * spread + h[first[d] + k]
            docs.append(d)
            keys.append(a + np.uint64(few))
    doc, key = np.concatenate(docs), mix(np.concatenate(keys)) >> np.uint64(12)
    both = np.sort((doc.astype(np.uint64) << np.uint64(52)) | key)
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both >> np.uint64(52)).astype(np.int64), both & np.uint64((1 << 52) - 1)
