"""Exact dedup: groups come from neighbours in the sort; only heavy texts are split."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from hireflow.llm import exact_dedup as E


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_heavy_and_light_texts(spark, keep):
    rng = random.Random(6)
    long = "same beginning of sixty-four characters and more, over and over " * 3
    rows = [(k, "heavy") for k in range(900)] + [(1000 + k, long + str(k % 40)) for k in range(400)]
    rows += [(2000 + k, rng.choice(["a", "b", "", None, "A", " a", "a "])) for k in range(200)]
    rows += [(None, "heavy"), (None, "a"), (5, "heavy"), (5, "heavy"), (3000, "x" * 50_000), (3001, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    pick = (max if keep == "largest" else min)
    got = E.exact_dedup(df, keep=keep).collect()
    assert len(got) == len(rows)
    want = sorted((d, pick(x for x in g if x is not None), len(g)) for g in groups.values() for d in g if d is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id is not None) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_only_heavy_rows_are_grouped_by_a_digest(spark):
    """Without a heavy text no row leaves the sorted partitions: one range exchange carries the texts."""
    rows = [(k, f"text {k % 300}") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = E.exact_dedup(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "heavy" in plan and all(r.group_size == 3 for r in got.collect())
