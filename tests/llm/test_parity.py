"""Parity maps, flags and groups of copies around the threshold."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hireflow.llm.common import flag_table
from hireflow.llm.ngram_join import PARITY, _may_link, _parity, ngram_join

from . import brute


def test_maps_differ_in_no_more_bits_than_sets_differ_in_shingles(spark):
    rng, sets = random.Random(3), []
    base = [rng.getrandbits(52) for _ in range(400)]
    for cut in (0, 1, 20, 60, 200, 400):
        sets += [set(base[:400 - cut]) | {rng.getrandbits(52) for _ in range(k)} for k in (0, 1, 30, 100)]
    sets.append(set())
    doc = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)]).astype(np.int64)
    key = np.array([k for s in sets for k in s], np.uint64)
    odd = _parity(doc, key, len(sets))
    rows = [(i, len(s), *map(int, odd[i])) for i, s in enumerate(sets)]
    names = [f"odd{i}" for i in range(PARITY)]
    table = spark.createDataFrame(rows, "i int, size long, " + ", ".join(f"{c} long" for c in names))
    for percent in (80, 90):
        may = {(r.a, r.b) for r in table.alias("x").join(table.alias("y"), F.expr("x.i < y.i"))
               .filter(_may_link("x", "y", percent)).select(F.col("x.i").alias("a"), F.col("y.i").alias("b")).collect()}
        link = {(a, b) for b in range(len(sets)) for a in range(b)
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert link and link <= may and len(may) < len(sets) * (len(sets) - 1) // 2


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_copies_around_the_threshold(spark, words, percent):
    """Copies of one text with few to many edits: chains, heads that link with nothing, two clusters."""
    rng, rows = random.Random(11), []
    base = [f"w{rng.randrange(4000)}" for _ in range(220)]
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(220), rng.choice([1, 2, 3, 4, 5, 6, 8])):
            text[at] = f"e{k}x{at}" if k % 3 else f"shared{at % 40}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, words, percent).collect())
    want = sorted(brute.similar_groups(rows, words, percent))
    assert got == want and 1 < len({c for *_, c in want}) < 150


def test_flags(spark):
    up = [0, 1, 63, 64, 127, 4095, 1]
    table = flag_table(spark.createDataFrame([(x,) for x in up], "f long"), 4096)
    assert np.flatnonzero(table).tolist() == sorted(set(up)) and len(table) == 4096
    assert not flag_table(spark.createDataFrame([], "f long"), 100).any()
