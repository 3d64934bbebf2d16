"""What the operators send between tasks, and that it still suffices."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute

from hireflow.llm.ngram_join import BLOCK, BUCKETS, _block_classes, _bucket_counts
from hireflow.llm.substring_dedup import _anchors, _pieces, substring_dedup
from hireflow.llm.textkit import by_rarity, rarity_classes, slices, word_shingles

from . import brute


def _text(rng, n):
    return "".join(rng.choice("abcdefghij ") for _ in range(n))


def test_substring_dedup_sends_little_of_a_piece_that_stands_alone():
    rng = random.Random(5)
    texts = pa.array([_text(rng, 3000) for _ in range(60)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(60)), pa.array(np.arange(60) * 7919), texts],
                                       ["place", "tag", "text"])
    sent = sum(len(v) for out in _anchors(50, 8)(iter([batch])) for v in out.column("pieces").to_pylist())
    pieces = sum(len(_pieces(t, 50)[0]) for _, t in slices(texts))
    assert sent < 16 * pieces


def test_substring_dedup_of_copies_near_copies_and_frequent_anchors(spark):
    rng = random.Random(11)
    phrase, passage = _text(rng, 30), _text(rng, 90)
    near = [passage[:45] + c + passage[46:] for c in "xyz"]
    texts = [_text(rng, 80) + rng.choice([phrase, passage, *near, ""]) + _text(rng, rng.randrange(60)) for _ in range(120)]
    texts += [texts[k] for k in range(0, 120, 5)] + [texts[3] + texts[9], passage, passage, passage[:49], None, ""]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(None if i % 29 == 7 else i, t) for i, t in zip(ids, texts, strict=True)]
    rows += rows[:4]
    out = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute.substrings(rows)


def test_shingles_that_share_16_bits_have_their_own_rarity():
    often, seldom = 0x3A0005, 0x7B0005
    counts = np.ones(BUCKETS, np.int64)
    counts[often] = 40
    doc, key = by_rarity(np.zeros(2, np.int64), np.array([often, seldom], np.uint64), rarity_classes(counts))
    assert doc.tolist() == [0, 0] and key.tolist() == [seldom, often]


def test_bucket_counts_of_all_tasks_add_up():
    rng = random.Random(2)
    tasks = [pa.array([_text(rng, 400) for _ in range(20)]) for _ in range(3)]
    out = pa.Table.from_batches([b for t in tasks for b in _bucket_counts(3)(iter([
        pa.RecordBatch.from_arrays([t], ["text"])]))])
    want = np.zeros(BUCKETS, np.int64)
    for t in tasks:
        for _, texts in slices(t):
            np.add.at(want, (word_shingles(texts, 3)[1] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
    total = 0
    for block in set(out.column("block").to_pylist()) - {-1}:
        got = _block_classes((pa.scalar(block),), out.filter(pa.compute.equal(out.column("block"), block))).to_pylist()[0]
        mine = want[block * BLOCK:(block + 1) * BLOCK]
        assert got["classes"] == rarity_classes(mine).tobytes() and got["total"] == mine.sum()
        total += got["total"]
    assert total == want.sum() > 0
