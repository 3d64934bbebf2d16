"""Column-wise construction of the Burrows-Wheeler transform of many short strings.

Round j inserts one symbol of each string, its j-th from the right: the suffixes
of at most j symbols are then sorted, with the symbol before each (the transform)
and the length of its common prefix with the suffix above it. A round reads the
columns of the last one from files in order and writes its own: a suffix's place
follows from its symbol and the place of its rest, and its common prefix from the
least common prefix between the places of the two rests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

import numpy as np

_COLUMNS = {"symbol": np.uint16, "at": np.int32, "lcp": np.uint8}
_LOG = np.zeros(1 << 16, np.uint8)        # floor(log2) of small numbers
_LOG[1:] = np.frexp(np.arange(1, 1 << 16, dtype=np.float64))[1] - 1


class _Columns:
    """The columns of one round, one sequential file each. A round has as many rows as the one
    before or more, so files are written over and not made anew."""

    def __init__(self, stack: contextlib.ExitStack, folder: str, name: int):
        self.files = {c: stack.enter_context(open(os.path.join(folder, f"{c}.{name}"), "w+b", buffering=0))
                      for c in _COLUMNS}

    def write(self, parts: dict[str, list[np.ndarray]]) -> None:
        for c, kind in _COLUMNS.items():
            self.files[c].seek(0)
            for x in parts[c]:
                x.astype(kind, copy=False).tofile(self.files[c])

    def read(self, c: str) -> np.ndarray:
        self.files[c].seek(0)
        return np.fromfile(self.files[c], dtype=_COLUMNS[c])


def _least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(lcp[low + 1 .. high]) for each pair low < high, by a doubling table."""
    out = lcp[high]
    far = np.flatnonzero(high - low > 1)          # neighbours need no table
    if len(far):
        out[far] = _least_in_table(lcp, low[far], high[far])
    return out


def _least_in_table(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.empty(len(low), lcp.dtype)
    span = high - low
    level = _LOG[np.minimum(span, (1 << 16) - 1)]
    wide = np.flatnonzero(span >= 1 << 16)
    level[wide] = _LOG[span[wide] >> 16] + 16
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    table = lcp
    for k in range(len(bounds) - 1):
        mine = order[bounds[k]:bounds[k + 1]]
        if len(mine):
            out[mine] = np.minimum(table[low[mine] + 1], table[high[mine] - (1 << k) + 1])
        if k + 2 < len(bounds):
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
    return out


def sorted_suffixes(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common prefix with the one above, at most ``cap``) of all suffixes, sorted."""
    size = np.array([len(s) for s in strings], np.int64)
    # The strings end to end, a 0 before each: the symbol before a suffix is the one before
    # its place, and 0 says that the suffix is a whole string.
    text = np.zeros(int(size.sum()) + len(strings), np.uint16)
    first = np.cumsum(size + 1) - size
    inside = np.ones(len(text), bool)
    inside[first - 1] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    ends = (first + size).astype(np.int32)
    empty = {"symbol": text[ends - 1], "at": ends, "lcp": np.zeros(len(ends), np.uint8)}
    with tempfile.TemporaryDirectory() as folder, contextlib.ExitStack() as stack:
        rounds = [_Columns(stack, folder, k) for k in range(2)]
        rounds[0].write({c: [empty[c]] for c in _COLUMNS})
        for turn in range(1, int(size.max(initial=0)) + 1):
            old, new = rounds[(turn - 1) % 2], rounds[turn % 2]
            symbol = old.read("symbol")
            order = np.argsort(symbol, kind="stable").astype(np.int32)      # a radix sort: one pass by symbol
            symbol = symbol[order]
            whole = np.searchsorted(symbol, 1)
            order, symbol = order[whole:], symbol[whole:]
            at = old.read("at")[order] - 1
            lcp = np.zeros(len(at), np.uint8)
            same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
            rest = _least_between(old.read("lcp"), order[same - 1], order[same])
            lcp[same] = np.minimum(rest, cap - 1) + 1
            new.write({"symbol": [empty["symbol"], text[at - 1]], "at": [ends, at], "lcp": [empty["lcp"], lcp]})
        last = rounds[int(size.max(initial=0)) % 2]
        at, lcp = last.read("at").astype(np.int64), last.read("lcp")
    string = np.searchsorted(first, at, side="right") - 1
    return string, at - first[string], lcp


def repeated(strings: list[bytes], owner: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Where a string's ``width`` bytes also stand in a string of a smaller owner.

    Returns (string, first offset, number of offsets) for each run of such offsets.
    """
    string, offset, lcp = sorted_suffixes(strings, width)
    if not len(string):
        return []
    head = np.flatnonzero(lcp < width)
    head = head if len(head) and head[0] == 0 else np.concatenate([[0], head])
    group = np.zeros(len(string), np.int64)
    group[head[1:]] = 1
    least = np.minimum.reduceat(owner[string], head)[np.cumsum(group)]
    size = np.array([len(s) for s in strings], np.int64)
    hit = np.flatnonzero((owner[string] > least) & (offset <= size[string] - width))
    order = np.lexsort((offset[hit], string[hit]))
    s, o = string[hit][order], offset[hit][order]
    if not len(s):
        return []
    start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)]))
    count = np.diff(np.concatenate([start, [len(s)]]))
    return list(zip(s[start].tolist(), o[start].tolist(), count.tolist(), strict=True))
