"""What of the pieces that share their anchor is left to the transform."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from hireflow.llm import substring_dedup as S


def _text(rng, n):
    return "".join(rng.choice("abcdefghij ") for _ in range(n)).encode()


def _windows(strings, width):
    return [{s[a:a + width] for a in range(len(s) - width + 1)} for s in strings]


def _pieces(rng):
    """Strings of up to 76 bytes around a few passages, and their owners."""
    passages = [_text(rng, 60) for _ in range(6)]
    strings = [rng.randbytes(rng.randrange(9)) + p[rng.choice((0, 0, 4)):rng.choice((60, 60, 56))] + rng.randbytes(rng.randrange(8))
               for p in passages for _ in range(40)]
    return strings, np.array([rng.randrange(50) for _ in strings])


def test_narrowing_loses_no_repeat_and_leaves_little():
    rng = random.Random(3)
    strings, owner = _pieces(rng)
    settled, left, parts = S._narrowed(strings, owner, 50)
    assert sum(map(len, parts)) < 0.5 * sum(map(len, strings))
    string, offset, n = left
    found = {(i, a + k) for i, a, c in zip(*map(np.ndarray.tolist, settled), strict=True) for k in range(c)}
    assert [strings[i][a:a + c + 49] for i, a, c in zip(string, offset, n, strict=True)] == parts
    for i, a, c in S.repeated(parts, owner[string], 50):
        found |= {(string[i], offset[i] + a + k) for k in range(c)}
    every = _windows(strings, 50)
    want = {(i, a) for i, s in enumerate(strings) for a in range(len(s) - 49)
            if any(owner[j] < owner[i] and s[a:a + 50] in w for j, w in enumerate(every))}
    assert found == want


def test_records_of_a_document_take_no_row_for_each_bucket_of_anchors():
    rng = np.random.default_rng(4)
    place, tag = np.arange(3000) % 700, np.arange(3000) % 700 * 7919 - 1000
    columns = {"place": place, "tag": tag, "start": rng.integers(0, 9000, 3000).astype(np.int32),
               "n": rng.integers(1, 27, 3000).astype(np.int32)}
    sent = S._for_documents(S._SPAN, 8, **columns)
    assert sent.num_rows == 8
    out = pa.concat_tables([S._gathered(S._SPAN)(sent.slice(k, 1)) for k in range(8)])
    got = {(p, t, a, n) for p, t, f in zip(*(out.column(c).to_pylist() for c in ("place", "tag", "found")), strict=True)
           for a, n in np.frombuffer(f, S._SPAN).tolist()}
    assert out.num_rows == 700 and got == set(zip(*(columns[c].tolist() for c in columns), strict=True))
    assert S._for_documents(S._SPAN, 8, **{c: x[:0] for c, x in columns.items()}).num_rows == 0
