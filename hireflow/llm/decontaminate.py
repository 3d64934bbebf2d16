"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is cut into windows of consecutive words. A document contains a
window only if it holds all of the window's word shingles, so it must hold the
rarest one: with containment 1 the necessary prefix is one shingle long. Rarity is
counted over all documents. Documents and windows meet on that shingle's hash; the
place of the shingle in the window and the document's ends bound where the window
could lie, and the words there are compared one by one.

Tasks get a table of ``BUCKETS`` flags, whatever the size of the benchmark, to pass
over words that start no wanted shingle; everything else is an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, flag_table, row_key
from .textkit import ALNUM, LOWER, Texts, mix, slices

BUCKETS = 1 << 22
SHINGLE = 3       # words; a window of fewer words is one shingle


def _shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, from the words' hashes."""
    acc = h[:max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        acc = acc * np.uint64(0x100000001B3) + h[k:len(h) - size + 1 + k]
    return mix(acc + np.uint64(size))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


class _Words:
    """The words of a slice of documents and their shingles, none across documents."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.doc, self.start, self.end = texts.runs(ALNUM)
        self.hash = texts.hashes(self.start, self.end, lower=True)
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each shingle."""
        h = _shingle_hashes(self.hash, size)
        inside = np.flatnonzero(self.doc[:len(h)] == self.doc[size - 1:]) if len(h) else np.zeros(0, np.int64)
        return inside, h[inside]

    def words(self, low: int, high: int) -> list[str]:
        if low >= high:
            return []
        at = self.start[low]
        data = LOWER[self.texts.data[at:self.end[high - 1]]].tobytes()
        return [data[s - at:e - at].decode("utf-8", "replace")
                for s, e in zip(self.start[low:high], self.end[low:high], strict=True)]


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item_id")
            for first, texts in slices(batch.column("text")):
                w = _Words(texts)
                out: list[tuple] = []
                for i in np.flatnonzero(w.count):
                    low, n = int(w.first[i]), int(w.count[i])
                    size = min(n, window)
                    part = min(SHINGLE, size)
                    words, h = w.words(low, low + n), _shingle_hashes(w.hash[low:low + n], part)
                    for k in range(n - size + 1):
                        mine = h[k:k + size - part + 1]
                        out.append((items[first + int(i)].as_py(), words[k:k + size], size, part,
                                    mine.view(np.int64).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[j] for x in out], t) for j, t in enumerate(
                        (batch.schema.field("item_id").type, pa.list_(pa.string()), pa.int32(), pa.int32(),
                         pa.list_(pa.int64())))], ["item_id", "words", "size", "part", "hashes"])
    return run


def _count(sizes: list[int], wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = wanted.value, np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                w = _Words(texts)
                for size in sizes:
                    _, h = w.shingles(size)
                    b = _bucket(h)
                    np.add.at(total, b[table[b]], 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used], pa.int64())], ["bucket", "n"])
    return run


_SPOTS = pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32()), ("low", pa.int32()),
                             ("words", pa.list_(pa.string()))]))


def _spots(window: int, sizes: list[int], wanted):
    """Per row: its number of words, and where a wanted shingle may start, with the words around it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                w = _Words(texts)
                spots: dict[int, list] = {}
                for size in sizes:
                    at, h = w.shingles(size)
                    for j in np.flatnonzero(table[_bucket(h)]):
                        p = int(at[j])
                        d = int(w.doc[p])
                        low, high = int(w.first[d]), int(w.first[d] + w.count[d])
                        a, b = max(low, p - window + 1), min(high, p + window)
                        spots.setdefault(d, []).append(
                            {"hash": int(h[j].view(np.int64)), "place": p - low, "low": a - low,
                             "words": w.words(a, b)})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(first, len(texts)),
                     batch.column("doc_id").slice(first, len(texts)), pa.array(w.count, pa.int64()),
                     pa.array([spots.get(i) for i in range(len(texts))], _SPOTS)],
                    ["key", "doc_id", "n_words", "spots"])
    return run


def _flags(spark, rows: DataFrame):
    """A broadcast table of BUCKETS flags from a table (bucket)."""
    return spark.sparkContext.broadcast(flag_table(rows, BUCKETS))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items (sorted), contaminated, key.

    Words are runs of ASCII letters and digits and of all other non-ASCII characters,
    A-Z lower-cased. A window is ``window`` consecutive words of an item; an item of
    fewer words, but not none, is one window. A word inside any occurrence of a window
    is hit. key is common.row_key of the row, for joining the result to its input.

    Null and empty texts have no words, so they neither hit nor are hit. Rows that
    repeat share one result; items that repeat count once; an item with a null
    identifier hits words but is not listed. Either table may be empty; other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType.simpleString()
    windows = cut(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).mapInArrow(
        _windows(window), f"item_id {item_type}, words array<string>, size int, part int, hashes array<long>"))
    bucket = lambda c: F.col(c).bitwiseAND(F.lit(BUCKETS - 1))
    shingles = windows.select("words", "size", "part", F.posexplode("hashes").alias("place", "hash")) \
                      .distinct().withColumn("bucket", bucket("hash"))
    sizes = sorted(r["part"] for r in windows.select("part").distinct().collect())      # of 1, 2, 3
    text = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).alias("text"))

    wanted = _flags(spark, shingles.select("bucket"))
    counts = text.select("text").mapInArrow(_count(sizes, wanted), "bucket long, n long") \
                 .groupBy("bucket").agg(F.sum("n").alias("n"))
    prefix = cut(shingles.join(counts, "bucket", "left").groupBy("words", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "place")).alias("rarest"))
        .select("words", "size", F.col("rarest.hash").alias("hash"), F.col("rarest.place").alias("offset")))

    wanted = _flags(spark, prefix.select(bucket("hash").alias("bucket")))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = cut(text.mapInArrow(_spots(window, sizes, wanted),
                               f"key string, doc_id {id_type}, n_words long, spots array<struct<hash: long, "
                               "place: int, low: int, words: array<string>>>"))
    spots = rows.select("key", "n_words", F.explode("spots").alias("s")).select(
        "key", "n_words", "s.hash", "s.place", "s.low", F.col("s.words").alias("around"))
    start = F.col("place") - F.col("offset")
    hits = cut(spots.join(prefix, "hash").withColumn("start", start)
               .filter("start >= 0 and start + size <= n_words and start >= low")
               .filter("slice(around, start - low + 1, size) = words")
               .select("key", "words", "start", (F.col("start") + F.col("size")).alias("stop")).distinct())

    ordered = Window.partitionBy("key").orderBy("start", "stop")
    reach = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    hit = hits.select("key", "start", "stop").distinct().withColumn("reach", F.coalesce(reach, F.lit(0))) \
              .groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reach")))
                                  .alias("n_hit"))
    items = hits.select("key", "words").distinct().join(
        windows.select("words", F.col("item_id").cast("string").alias("item")).distinct(), "words") \
        .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return (rows.select("key", "doc_id", "n_words").join(hit, "key", "left").join(items, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"), "key"))
