"""Distributed positions and dense ranks against Python sorts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hireflow.operators.ranking import dense_rank, distinct_ranks, positions


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.5, 2.5, 2.5, 2.5, rng.random()]), rng.choice("abc")) for k in range(2000)]
    return rows, spark.createDataFrame(rows, "k long, v double, g string").repartition(7)


def test_positions_are_a_total_order(table):
    rows, df = table
    got = positions(df, F.col("v").desc_nulls_last(), "k", parts=9).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.k, r.position) for r in sorted(got, key=lambda r: r.position)] == [(r[0], i) for i, r in enumerate(want)]


def test_ties_are_split_but_stay_in_order(table):
    rows, df = table
    got = sorted(positions(df, "g", parts=6).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows))) and [r.g for r in got] == sorted(r[2] for r in rows)


@pytest.mark.parametrize("descending", [False, True])
def test_dense_rank(table, descending):
    rows, df = table
    values = sorted({r[1] for r in rows if r[1] is not None}, reverse=descending)
    rank = {v: i + 1 for i, v in enumerate([*values, None])}
    got = dense_rank(df, "v", descending=descending).collect()
    assert sorted((r.k, r["rank"]) for r in got) == sorted((r[0], rank[r[1]]) for r in rows)
    counts = {r.v: r.n for r in distinct_ranks(df, "v").collect()}
    assert counts[2.5] == sum(r[1] == 2.5 for r in rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "v double")
    assert positions(empty, "v").collect() == [] and dense_rank(empty, "v").collect() == []


def test_no_window_over_rows(table):
    """The only window without a partition sees one row per range partition."""
    _, df = table
    plan = positions(df, "v", parts=5)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "Aggregate" in window.splitlines()[1] or "Aggregate" in window.splitlines()[2]
