"""Steps that grew faster than their input: forms judged once, store calls, alike jobs, tasks of audits."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hireflow.functions import rules as X
from hireflow.operators import audit as K
from hireflow.operators import eligible_counts as EC
from hireflow.operators import intake as V
from hireflow.operators import skill_index as S
from hireflow.streaming import jobs as ST


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_forms_are_judged_once(spark, seed):
    form = spark.createDataFrame([("a", 1, "Online", "Scheduled", " x ", "1", "2001-2-3", "9:30")],
                                 "form_id string, company_id long, mode string, interview_status string, remarks string, "
                                 "application_id string, interview_date string, interview_time string")
    for half in V.intake_interviews(seed, form):
        assert "rlike" not in _plan(half) and "join" not in _plan(half)


def test_strip_without_a_pattern(spark):
    texts = ["", " ", "a", " a b 　", "\x1c\x85x\r\n", "  y z\t\n\x0b", "x" * 501, "​q​", None, "\n \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.strip("t").alias("s"))
    assert {(r.t, r.s) for r in df.collect()} == {(t, (t or "").strip()) for t in texts}
    assert "regexp_replace" not in _plan(df)


def test_forms_of_one_file_are_dealt_out(spark):
    one = spark.range(100).select(F.col("id").alias("form_id")).coalesce(1)
    assert V._dealt(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


class _Store:
    def __init__(self):
        self.calls, self.held = 0, False

    def exists(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls += 1
        self.held = True


def _request(n, ts, reasons=()):
    return SimpleNamespace(request_id=n, student_id=1, job_id=2, ts=ts, reasons=list(reasons))


def test_refused_requests_never_reach_the_store():
    pairs = ST._OnePerPair()
    pairs.admitted = _Store()
    out = list(pairs.handleInputRows((None, None, 7), iter([_request(1, 5, ["no"]), _request(2, 4, ["no"])]), None))
    assert [(r.request_id, r.reasons, r.settled) for r in out] == [(1, ["no"], False), (2, ["no"], False)]
    assert pairs.admitted.calls == 0
    first = list(pairs.handleInputRows((1, 2, None), iter([_request(3, 5), _request(4, None), _request(5, 4)]), None))
    assert {r.request_id: r.reasons for r in first} == {3: [ST.REASON_DUPLICATE], 4: [], 5: [ST.REASON_DUPLICATE]}
    later = list(pairs.handleInputRows((1, 2, None), iter([_request(6, 1), _request(7, 2)]), None))
    assert {r.request_id: r.reasons for r in later} == {6: [ST.REASON_APPLIED], 7: [ST.REASON_DUPLICATE]}


def test_refused_repeats_of_a_micro_batch(spark):
    rows = [(1, 1, 2, 9, ["no"], False), (2, 1, 2, 8, ["no"], False), (3, None, 2, None, ["none"], False),
            (4, None, 2, 1, ["none"], False), (5, 4, 2, 1, [], True), (6, 4, 2, 1, ["x"], True)]
    df = spark.createDataFrame(rows, "request_id long, student_id long, job_id long, ts long, reasons array<string>, settled boolean")
    got = {r.request_id: r.reasons for r in ST._repeats_marked(df).collect()}
    assert got == {1: [ST.REASON_DUPLICATE], 2: ["no"], 3: ["none"], 4: [ST.REASON_DUPLICATE], 5: [], 6: ["x"]}


@pytest.mark.parametrize("skills", [9, 400])       # below and above FEW_SKILLS
def test_places_with_weights(spark, skills):
    rng = random.Random(skills)
    places = {p: (set(rng.sample(range(skills), rng.randrange(3))), rng.randrange(1, 9))
              for p in [*range(900), S.BLOCK - 1, S.BLOCK, S.BLOCK + 70]}
    owned = spark.createDataFrame([(p, s) for p, (own, _) in places.items() for s in own], "place long, skill_id long")
    weighed = spark.createDataFrame([(p, w) for p, (_, w) in places.items()], "place long, weight long")
    asked = [(k, sorted(rng.sample(range(skills), rng.randrange(skills))), rng.choice([0, 1, 64, 899, 900]))
             for k in range(40)]
    got = {r.k: r.n for r in S.count_within(spark.createDataFrame(asked, "k long, skills array<long>, cut long"), owned, weighed).collect()}
    assert got == {k: sum(w for p, (own, w) in places.items() if p < cut and own <= set(have)) for k, have, cut in asked}


def test_alike_jobs_are_one_place(spark, seed, monkeypatch):
    found = {}

    def seen(questions, owned, weighed=None):
        found["weights"] = None if weighed is None else [r.weight for r in weighed.collect()]
        return questions.withColumn("n", F.lit(0))
    monkeypatch.setattr(EC, "count_within", seen)
    jobs = seed.job
    twice = seed.with_tables(job=jobs.unionByName(jobs))
    EC.eligible_jobs_per_student(twice)
    assert found["weights"] and min(found["weights"]) >= 2


def test_audits_in_small_tasks(spark, seed, monkeypatch):
    at = []

    def seen(df):
        at.append(int(spark.conf.get(K.TASK_SIZE).rstrip("b")))
        return df
    monkeypatch.setattr(K, "checkpointed", seen)
    before = spark.conf.get(K.TASK_SIZE)
    for audit in (K.audit_pk, K.audit_unique, K.audit_fk):
        audit(seed)
    assert at == [K.TASK_BYTES] * 3 and spark.conf.get(K.TASK_SIZE) == before
