"""Sharding: a brute-force version of both passes, and what the law promises."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hireflow.llm import queries as Q
from hireflow.llm import sharding as S

SF = "/root/testdata/sf0.001"


def rows():
    out = [(k, f"text {k} " * (k % 50)) for k in range(500)]
    out += [(1000 + k, "one text under many ids") for k in range(300)]       # a group of copies
    out += [(7, "a repeated row")] * 250 + [(None, None)] * 40 + [(None, "")] * 3 + [(2000, None), (2001, "é" * 9)]
    return [*out, (2002, "long " * 40_000)]


def frame(spark, parts):
    return (spark.createDataFrame(rows(), "doc_id long, text string").repartition(parts)
            .select("*", F.lit(1).alias("size"), F.lit("x").alias("slot"), F.lit("x").alias("shard")))


@pytest.mark.parametrize("bucket_bytes", [4000, 1 << 30])
def test_law_and_round_trip(spark, bucket_bytes):
    out = S.shard_documents(frame(spark, 6), shards=7, bucket_bytes=bucket_bytes).collect()
    want = Counter(rows())
    assert Counter((r.row.doc_id, r.row.text) for r in out) == want
    assert all(r.size == len((r.row.text or "").encode()) + 1 for r in out)
    assert all(r.text_crc32 == zlib.crc32((r.row.text or "").encode()) for r in out)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(7):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(counts[shard]))


def test_order_equals_brute_force(spark):
    """Both passes again in plain Python from the rows' names."""
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None and r[0] != 7], "doc_id long, text string")
    got = {r.row.doc_id: (r.shard, r.slot) for r in S.shard_documents(docs, shards=5, bucket_bytes=9000).collect()}
    total = sum(len((t or "").encode()) + 1 for _, t in docs.collect())
    buckets = -(-total // 9000)
    named = docs.select("doc_id", F.xxhash64(F.lit(2024), F.col("doc_id").cast("string"),
                                             F.xxhash64(F.lit(2024), "text"), F.lit(-1).cast("long")).alias("name"))
    named = named.select("*", F.pmod(F.xxhash64(F.lit(2025), "name"), F.lit(buckets)).alias("bucket")).collect()
    order = []
    for bucket in range(buckets):
        inside = [r.doc_id for r in sorted((r for r in named if r.bucket == bucket), key=lambda r: r.name)]
        words = np.random.Philox(key=[2024, bucket]).random_raw(max(1, len(inside))).tolist()
        for i in reversed(range(1, len(inside))):
            j = words[i] * (i + 1) // 2**64
            inside[i], inside[j] = inside[j], inside[i]
        order += inside
    assert got == {doc: (p % 5, p // 5) for p, doc in enumerate(order)}


def test_same_shards_whatever_the_partitions_and_other_ones_by_seed(spark):
    distinct = [r for r in dict.fromkeys(rows())]
    def run(parts, seed):
        df = spark.createDataFrame(distinct, "doc_id long, text string").repartition(parts)
        return sorted(((r.row.doc_id, r.row.text, r.shard, r.slot) for r in
                       S.shard_documents(df, bucket_bytes=20_000, seed=seed).collect()), key=str)
    one = run(3, 1)
    assert one == run(8, 1) and one != run(3, 2)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(S.fisher_yates(3, 9, bucket)) for bucket in range(6000))
    assert len(seen) == 6 and all(800 < n < 1200 for n in seen.values())
    assert sorted(S.fisher_yates(1000, 1, 1)) == list(range(1000)) and len(S.fisher_yates(0, 1, 1)) == 0


def test_hot_groups_spread_over_the_buckets(spark):
    out = S.shard_documents(frame(spark, 4), bucket_bytes=4000)
    sizes = Counter(r.bucket for r in out.filter("row.text <> 'long'").select("bucket").collect())
    for text, n in (("a repeated row", 250), ("one text under many ids", 300)):
        most = max(Counter(r.bucket for r in out.filter(F.col("row.text") == text).select("bucket").collect()).values())
        assert most < n / 5
    assert len(sizes) > 50


def test_written_shards_and_empty_table(spark, tmp_path):
    S.write_shards(S.shard_documents(frame(spark, 3).select("doc_id", "text"), shards=4), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == len(rows()) and back.select("shard").distinct().count() == 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.shard_documents(empty).collect() == []


def test_query_covers_the_table(spark):
    out = Q.QUERIES["op12_sharding"](spark, SF)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
