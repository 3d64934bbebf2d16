"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hireflow.llm import queries as Q
from hireflow.llm.importance import importance_resample
from hireflow.plans.compare import compare, duck

from .brute import low

SF = "/root/testdata/sf0.001"


def features(text, longest):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(words), [zlib.crc32(" ".join(words[k:k + n]).encode()) for n in range(1, longest + 1)
                        for k in range(len(words) - n + 1)]


def plain(docs, target, longest=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    raw, wanted = [0] * buckets, [0] * buckets
    for texts, counts in (((t for _, t in docs), raw), (target, wanted)):
        for text in texts:
            for crc in features(text, longest)[1]:
                counts[crc % buckets] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(wanted) + buckets))))
            for s, t in zip(raw, wanted, strict=True)]
    out = []
    for doc, text in docs:
        n, crcs = features(text, longest)
        weight = sum(gain[c % buckets] for c in crcs)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, n, len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(fit[:len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.fixture(scope="module")
def table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, None), (None, "word " * 30), (9_001, ""), (9_002, " \n"), (9_003, "ÀÉ É-é A1b2_c3 " * 9), (9_004, "tie " * 25),
             (9_004, "tie " * 25), (9_004, "tie " * 26), (9_005, "deux mots " * 20_000), (9_006, "\x00\x7f@`{")]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, "", "mots"]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"longest": 3, "buckets": 997, "percent": 40, "seed": 1}, {"longest": 2, "min_words": 0, "percent": 100}])
def test_equals_plain_version(spark, table, options):
    docs, items = table
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).select(
        "*", *[F.lit(0).alias(c) for c in ("score", "rank", "weight", "id", "place", "bucket", "n")])
    target = spark.createDataFrame([(t,) for t in items], "text string").withColumn("n", F.lit(1))
    got = importance_resample(df, target, **options).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, **options)


def test_empty_tables(spark, table):
    docs, _ = table
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance_resample(none, none).collect() == []
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance_resample(df, none).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, [])


def test_query_equals_sql(spark):
    assert compare(Q.QUERIES["op13_importance"](spark, SF), Q.ORACLE_SQL["op13_importance"], duck(SF))["ok"]
