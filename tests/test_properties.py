"""Property tests: the planned eligibility operators equal a brute-force check.

Random small domains (skills held by most students, repeated CGPA values, jobs
without skills, closed and overdue jobs) go through the exact counts per job and per
student and through ``eligibility_pairs`` (reasons in order, missing skills by name,
flags, decision), and are compared with a direct evaluation of the rules.
"""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hireflow.operators import eligibility as E
from hireflow.operators import eligible_counts as EC
from hireflow.sources.schema import TABLES

AS_OF = "2026-10-01"
SKILLS = [(k, f"Skill{k}") for k in range(1, 7)]
DEADLINES = [dt.date(2026, 9, 30), dt.date(2026, 10, 1), dt.date(2026, 12, 31)]


@st.composite
def domains(draw):
    n_students = draw(st.integers(1, 12))
    n_jobs = draw(st.integers(1, 8))
    students = [(s, f"S{s}", f"s{s}@x.example", dt.date(2003, 1, 1),
                 draw(st.sampled_from([0, 650, 700, 700, 800, 1000])), 2025, 1)
                for s in range(1, n_students + 1)]
    held = sorted({(s, k) for s in range(1, n_students + 1)
                   for k in draw(st.sets(st.sampled_from([1, 1, 2, 3, 4, 5, 6]), max_size=4))})
    jobs = [(j, 1, 11, f"J{j}", "Full-time", "d", "Pune",
             draw(st.sampled_from([0, 650, 700, 800, 1000, 1001])),
             draw(st.sampled_from(DEADLINES)), 1000.0,
             draw(st.sampled_from(["Open", "Open", "Closed"])))
            for j in range(1, n_jobs + 1)]
    required = sorted({(j, k) for j in range(1, n_jobs + 1)
                       for k in draw(st.sets(st.integers(1, 6), max_size=3))})
    applied = sorted(draw(st.sets(st.tuples(st.integers(1, n_students), st.integers(1, n_jobs)),
                                  max_size=6)))
    return students, held, jobs, required, applied


def brute_force(students, held, jobs, required, applied):
    holds = {}
    for s, k in held:
        holds.setdefault(s, set()).add(k)
    needs = {}
    for j, k in required:
        needs.setdefault(j, set()).add(k)
    as_of = dt.date.fromisoformat(AS_OF)
    division, eligible = set(), {}
    for j, *_, min_cgpa, deadline, _salary, status in jobs:
        for s, *_, cgpa, _year, _dept in students:
            covers = needs.get(j, set()) <= holds.get(s, set())
            if needs.get(j) and covers:
                division.add((s, j))
            if status == "Open" and deadline >= as_of and covers and cgpa >= min_cgpa:
                eligible[(s, j)] = (s, j) in set(applied)
    return division, eligible


def domain_of(seed, students, held, jobs, required, applied):
    spark = seed.spark
    return seed.with_tables(
        skill=spark.createDataFrame(SKILLS, TABLES["skill"].schema),
        student=spark.createDataFrame(students, TABLES["student"].schema),
        student_skill=spark.createDataFrame([(s, k, "Beginner") for s, k in held],
                                            TABLES["student_skill"].schema),
        job=spark.createDataFrame(jobs, TABLES["job"].schema),
        job_skill=spark.createDataFrame(required, TABLES["job_skill"].schema),
        application=spark.createDataFrame(
            [(100 + i, s, j, dt.date(2026, 9, 1), "Applied") for i, (s, j) in enumerate(applied)],
            TABLES["application"].schema))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(domains())
def test_counts_equal_brute_force(seed, domain):
    students, held, jobs, required, applied = domain
    division, eligible = brute_force(*domain)
    T = domain_of(seed, *domain)
    got = {r.job_id: (r.n_skills, r.students_with_all_skills) for r in EC.skill_holders_per_job(T).collect()}
    for j, *_ in jobs:
        n = len({k for x, k in required if x == j})
        assert got[j] == (n, sum(b == j for _, b in division) if n else len(students))
    per_job = {r.job_id: r.eligible_students for r in EC.eligible_students_per_job(T, AS_OF).collect()}
    assert {j: n for j, n in per_job.items() if n} == {
        j: n for j, *_ in jobs if (n := sum(b == j for _, b in eligible))}
    per_student = {r.student_id: r.eligible_jobs for r in EC.eligible_jobs_per_student(T, AS_OF).collect()}
    assert per_student == {s[0]: sum(a == s[0] for a, _ in eligible) for s in students}


def test_counts_follow_the_rules_of_single_decisions(seed):
    """CGPA outside 0..1000 and required skills that no table lists count as in E1."""
    day = dt.date(2026, 12, 31)
    students = [(1, "A", "a@x.example", dt.date(2003, 1, 1), 1050, 2025, 1),
                (2, "B", "b@x.example", dt.date(2003, 1, 1), -5, 2025, 1)]
    jobs = [(1, 1, 11, "J1", "Full-time", "d", "Pune", 1001, day, 1000.0, "Open"),
            (2, 1, 11, "J2", "Full-time", "d", "Pune", -5, day, 1000.0, "Open")]
    T = domain_of(seed, students, [], jobs, [(2, 777)], [])
    ask = seed.spark.createDataFrame([(s, j) for s in (1, 2) for j in (1, 2)], "student_id bigint, job_id bigint")
    want = {(r.student_id, r.job_id) for r in E.eligibility_pairs(T, ask, AS_OF).collect() if r.eligible}
    assert want == {(1, 1), (1, 2), (2, 2)}
    per_job = {r.job_id: r.eligible_students for r in EC.eligible_students_per_job(T, AS_OF).collect()}
    assert per_job == {j: sum(b == j for _, b in want) for j in (1, 2)}


def brute_force_decisions(students, held, jobs, required, applied):
    names = dict(SKILLS)
    holds, needs = {}, {}
    for s, k in held:
        holds.setdefault(s, set()).add(k)
    for j, k in required:
        needs.setdefault(j, set()).add(k)
    as_of = dt.date.fromisoformat(AS_OF)
    out = {}
    for j, *_, min_cgpa, deadline, _salary, status in jobs:
        for s, *_, cgpa, _year, _dept in students:
            missing = sorted(names[k] for k in needs.get(j, set()) - holds.get(s, set()))
            reasons = []
            if cgpa < min_cgpa:
                reasons.append(E.REASON_CGPA)
            if missing:
                reasons.append(E.REASON_MISSING + ", ".join(missing))
            if not (status == "Open" and deadline >= as_of):
                reasons.append(E.REASON_CLOSED)
            eligible, already = not reasons, (s, j) in set(applied)
            decision = (E.DECISION_ALREADY if eligible and already
                        else E.DECISION_ELIGIBLE if eligible else E.DECISION_NOT_ELIGIBLE)
            out[(s, j)] = (tuple(reasons), tuple(missing), eligible, already,
                           eligible and not already, decision)
    return out


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(domains())
def test_decisions_equal_brute_force(seed, domain):
    students, _held, jobs, _required, _applied = domain
    T = domain_of(seed, *domain)
    asked = [(s[0], j[0]) for s in students for j in jobs] + [(999, jobs[0][0]), (students[0][0], 999)]
    pairs = seed.spark.createDataFrame(asked, "student_id bigint, job_id bigint")
    got = {(r.student_id, r.job_id): (tuple(r.reasons), tuple(r.missing_skills), r.eligible,
                                      r.already_applied, r.can_apply, r.decision)
           for r in E.eligibility_pairs(T, pairs, AS_OF).collect()}
    assert got == brute_force_decisions(*domain)   # unknown student / job: no row
