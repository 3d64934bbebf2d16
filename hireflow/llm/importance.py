"""Target-distribution importance resampling over hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks separators, so a text in UTF-8 is one
``translate`` and one ``split``; the crc32 of an n-gram is the crc32 of the one before it,
extended by a blank and the next word; Counters reduce the words of a batch before any is
hashed. Two frequency tables, one of the raw and one of the target texts, each of ``buckets``
numbers, give every bucket its gain (a whole number of thousandths of a nat). A document's weight
is the sum of the gains of its features; a Gumbel number from its id turns weights into a
sample without replacement: the highest scores are drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions
from .common import cut

_MEMO = 1 << 18       # words whose gain a task remembers at a time


def _translation() -> bytes:
    """A-Z become a-z; digits, a-z and every byte from 0x80 stay; all else becomes a blank."""
    table = bytearray(b" " * 256)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return bytes(table)


WORDS = _translation()


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _grams(words: list[bytes], longest: int) -> Iterator[int]:
    """crc32 of every run of 1 to ``longest`` words, joined by blanks."""
    links = [b" " + w for w in words] if longest > 1 else words
    for k, word in enumerate(words):
        crc = zlib.crc32(word)
        yield crc
        for link in links[k + 1:k + longest]:
            crc = zlib.crc32(link, crc)
            yield crc


def _counter(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each bucket is hit by the texts of a task."""
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            seen: Counter = Counter()
            if longest == 1:
                for text in _texts(batch.column(0)):
                    seen.update(text.translate(WORDS).split())
                hits = ((zlib.crc32(w), n) for w, n in seen.items())
            else:
                for text in _texts(batch.column(0)):
                    seen.update(_grams(text.translate(WORDS).split(), longest))
                hits = seen.items()
            for crc, n in hits:
                total[crc % buckets] += n
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit, pa.int64()), "n": pa.array(total[hit], pa.int64())})
    return count


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n) over whole texts; buckets without a feature have no row."""
    return (texts.select(F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_counter(longest, buckets), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def _table(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts on the driver: ``buckets`` numbers, whatever the data."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of the smoothed target share over the smoothed raw share, per bucket."""
    n = float(len(raw))
    of_raw, of_target = float(raw.sum()), float(target.sum())
    return [math.floor(1000.0 * math.log((t + 1.0) * (of_raw + n) / ((s + 1.0) * (of_target + n))))
            for s, t in zip(raw.tolist(), target.tolist(), strict=True)]


class _WordGains(dict):
    """word -> gain, hashed when first met; forgets everything when it is full."""

    def __init__(self, gains: list[int]):
        super().__init__()
        self.gains = gains

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        gain = self[word] = self.gains[zlib.crc32(word) % len(self.gains)]
        return gain


def _gumbel(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def _scorer(gains: list[int], longest: int, seed: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = _WordGains(gains)
        n_buckets = len(gains)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            n_words, n_features, weights, scores = [], [], [], []
            for doc_id, text in zip(ids, _texts(batch.column(1)), strict=True):
                words = text.translate(WORDS).split()
                if longest == 1:
                    features, weight = len(words), sum(map(of_word.__getitem__, words))
                else:
                    runs = Counter(crc % n_buckets for crc in _grams(words, longest))
                    features = sum(runs.values())
                    weight = sum(gains[b] * n for b, n in runs.items())
                n_words.append(len(words))
                n_features.append(features)
                weights.append(weight)
                scores.append(weight + _gumbel("null" if doc_id is None else doc_id, seed))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), **{
                name: pa.array(x, pa.int64()) for name, x in (
                    ("n_words", n_words), ("n_features", n_features), ("weight", weights), ("score", scores))}})
    return score


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_text_col: str = "text", longest: int = 1, buckets: int = 10_000,
                        min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight, score, rank.

    rank counts 1, 2, 3 ... from the highest score, over the floor(percent * N / 100) drawn of the N
    documents with at least ``min_words`` words; it is null for documents that are not drawn. Ties go to
    the smaller doc_id. ``buckets`` bounds what reaches the driver and the tasks (two numbers a
    bucket); corpus counts cover all rows and whole texts.

    Null and empty texts have no words, no features and weight 0. A null identifier draws its
    number as the word ``null`` and loses ties; of repeated identifiers with equal scores the one with fewer
    features comes first, rows that are still equal are interchangeable. An empty target gives every
    bucket the smoothed count alone; an empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    if longest < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("longest and buckets must be positive, percent between 0 and 100")
    gains = bucket_gains(_table(bucket_counts(docs, text_col, longest, buckets), buckets),
                         _table(bucket_counts(target, target_text_col, longest, buckets), buckets))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    scored = cut(rows.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(
        _scorer(gains, longest, seed), "id string, n_words long, n_features long, weight long, score long")
        .select(F.col("id").cast(id_type).alias("doc_id"), "n_words", "n_features", "weight", "score"))
    fit = scored.filter(F.col("n_words") >= min_words)
    draw = fit.count() * percent // 100
    ranked = positions(fit, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight",
                       name="place")
    rank = F.when(F.col("place") < draw, F.col("place") + 1)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return (ranked.select(*columns, rank.cast("long").alias("rank"))
            .unionByName(scored.filter(F.col("n_words") < min_words)
                         .select(*columns, F.lit(None).cast("long").alias("rank"))))
