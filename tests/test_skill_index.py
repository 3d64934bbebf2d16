"""The bitmap index against sets in Python, over several blocks; rank intervals against pairs."""

from __future__ import annotations

import random

import pytest

from hireflow.operators import eligible_counts as EC
from hireflow.operators import skill_index as S
from hireflow.sources.binding import Domain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def owners():
    """Places over four blocks (the third one empty), with 0 to 6 of 9 skills; bits at both ends of words."""
    rng = random.Random(8)
    places = sorted({0, 63, 64, 65_535, 65_536, 65_599, 3 * S.BLOCK, *rng.sample(range(2 * S.BLOCK), 900)})
    return {p: set(rng.sample(range(9), rng.randrange(7))) for p in places}


def questions(rng, owners):
    cuts = [0, 1, 63, 64, 65, 65_535, 65_536, 65_537, 2 * S.BLOCK, 3 * S.BLOCK, 3 * S.BLOCK + 1]
    return [(k, sorted(rng.sample(range(11), rng.randrange(1, 5))), rng.choice(cuts)) for k in range(150)]


@pytest.mark.parametrize("mode", ["holders", "within"])
def test_counts(spark, owners, mode):
    asked = questions(random.Random(mode), owners)
    owned = spark.createDataFrame([(p, s) for p, skills in owners.items() for s in skills], "place long, skill_id long")
    df = spark.createDataFrame(asked, "k long, skills array<long>, cut long").repartition(3)
    count = S.count_holders if mode == "holders" else S.count_within
    got = {r.k: r.n for r in count(df, owned).collect()}
    for k, skills, cut in asked:
        if mode == "holders":
            want = sum(p < cut and set(skills) <= s for p, s in owners.items())
        else:     # places without any skill count too
            want = cut - sum(p < cut and not s <= set(skills) for p, s in owners.items())
        assert got[k] == want, (k, skills, cut)


def test_no_skills_asked_and_no_owners(spark):
    none = spark.createDataFrame([], "place long, skill_id long")
    df = spark.createDataFrame([(1, [], 70_000), (2, [5], 70_000), (3, [], 0)], "k long, skills array<long>, cut long")
    assert {r.k: r.n for r in S.count_holders(df, none).collect()} == {1: 70_000, 2: 0, 3: 0}
    assert {r.k: r.n for r in S.count_within(df, none).collect()} == {1: 70_000, 2: 70_000, 3: 0}


def test_no_set_meets_another_in_the_plan(spark):
    """Questions join the index by tile only; sets of students never meet sets of jobs."""
    plan = EC.eligible_students_per_job(Domain(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert "array_except" not in plan


def test_rank_intervals_decide_every_pair(spark):
    T = Domain(spark, SF)
    place = {r.student_id: (r.place, r.cgpa_x100) for r in EC.student_cgpa_ranks(T).collect()}
    for j in EC.cgpa_rank_intervals(T).collect():
        for at, cgpa in place.values():
            assert (cgpa >= j.min_cgpa_x100) == (at <= (j.last_place or 0))
