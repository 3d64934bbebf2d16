"""Hand-derived expectations on the seed-shaped fixture (tests/fixture.py)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hireflow.operators import audit as K
from hireflow.operators import catalogue as C
from hireflow.operators import changes as M
from hireflow.operators import eligibility as E
from hireflow.operators import eligible_counts as EC
from hireflow.operators import reports as R

AS_OF = "2026-10-01"


def pairs(df, a="student_id", b="job_id"):
    return sorted((r[a], r[b]) for r in df.select(a, b).collect())


def every_pair(seed):
    return seed.student.select("student_id").crossJoin(seed.job.select("job_id"))      # a handful of rows


def test_pair_decisions_and_counts_agree(seed):
    decided = [r for r in E.eligibility_pairs(seed, every_pair(seed), AS_OF).collect() if r.eligible]
    assert sorted((r.student_id, r.job_id, r.can_apply) for r in decided) == [
        (1, 1, False), (1, 3, False), (2, 3, True), (3, 1, True), (3, 2, False), (3, 3, True), (4, 3, True)]
    per_job = {r.job_id: r.eligible_students for r in EC.eligible_students_per_job(seed, AS_OF).collect()}
    assert {j: n for j, n in per_job.items() if n} == {1: 2, 2: 1, 3: 4}
    per_student = {r.student_id: r.eligible_jobs for r in EC.eligible_jobs_per_student(seed, AS_OF).collect()}
    assert per_student == {1: 2, 2: 1, 3: 3, 4: 1}


def test_deadline_day_counts_and_next_day_closes(seed):
    on_day = {r.job_id: r.eligible_students for r in EC.eligible_students_per_job(seed, "2026-10-20").collect()}
    after = {r.job_id: r.eligible_students for r in EC.eligible_students_per_job(seed, "2026-10-21").collect()}
    assert on_day[1] == 2 and 1 not in after
    assert {j: n for j, n in after.items() if n} == {2: 1, 3: 4}


def test_skill_holders_per_job(seed):
    got = {r.job_id: r.students_with_all_skills for r in EC.skill_holders_per_job(seed).collect() if r.n_skills}
    assert {j: n for j, n in got.items() if n} == {1: 2, 2: 1}


def test_division_for_one_job_and_job_without_skills(seed):
    assert sorted(r.student_id for r in C.q41_students_with_all_skills(seed, job_id=1).collect()) == [1, 3]
    # a job requiring nothing admits every student
    assert C.q41_students_with_all_skills(seed, job_id=3).count() == 4


def test_eligible_counts_histogram(seed):
    got = {r.job_id: r.eligible_students for r in E.eligible_counts(seed).collect()}
    assert got == {1: 3, 2: 3, 3: 4, 5: 4}
    rep = {r.job_id: (r.eligible_students, r.not_eligible_students)
           for r in C.q42_cgpa_report_open_jobs(seed).collect()}
    assert rep == {1: (3, 1), 2: (3, 1), 3: (4, 0), 5: (4, 0)}


def test_reasons_in_order_and_closed_once(seed):
    p = seed.spark.createDataFrame([(2, 1), (4, 4), (4, 5), (3, 1)], "student_id bigint, job_id bigint")
    got = {(r.student_id, r.job_id): (r.reasons, r.missing_skills, r.eligible, r.decision)
           for r in E.eligibility_pairs(seed, p, AS_OF).collect()}
    assert got[(2, 1)][0] == [E.REASON_CGPA, E.REASON_MISSING + "SQL"]
    assert got[(2, 1)][1] == ["SQL"]
    assert got[(4, 4)][0] == [E.REASON_CLOSED]          # closed: one message
    assert got[(4, 5)][0] == [E.REASON_CLOSED]          # overdue: same single message
    assert got[(3, 1)][2] is True and got[(3, 1)][3] == E.DECISION_ELIGIBLE


def test_admission_batch(seed):
    accepted, rejected = E.admit_applications(seed, seed.application_request, AS_OF)
    acc = [tuple(r) for r in accepted.collect()]
    highest = max(r.application_id for r in seed.application.collect())
    assert acc == [(highest + 1, 3, 1, dt.date(2026, 10, 1), "Applied", 1)]      # a new id, and the request that got it
    rej = {r.request_id: r.reasons for r in rejected.collect()}
    assert rej == {2: [E.REASON_DUPLICATE], 3: [E.REASON_APPLIED],
                   4: [E.REASON_CGPA, E.REASON_MISSING + "SQL"], 5: [E.REASON_NOT_FOUND],
                   6: [E.REASON_CLOSED]}
    assert accepted.count() + rejected.count() == seed.application_request.count()


def test_latest_interview_both_forms(seed):
    a = {r.application_id: r.interview_id for r in R.latest_interview(seed).collect()}
    b = {r.application_id: r.interview_id for r in R.latest_interview_window(seed).collect()}
    assert a == b == {10: "i2", 12: "i3", 99: "i4"}


def test_company_directory_counts_without_fanout(seed):
    got = {r.company_name: (r.recruiter_count, r.opportunity_count)
           for r in R.company_directory(seed).collect()}
    assert got == {"Acme": (2, 2), "Beta": (1, 3)}


def test_status_summary_shows_zero_statuses(seed):
    got = {r.company_id: (r.applied, r.shortlisted, r.selected, r.rejected, r.total)
           for r in R.status_summary(seed, True).collect()}
    assert got == {1: (2, 1, 0, 1, 4), 2: (0, 0, 1, 0, 1)}


def test_scoped_visibility(seed):
    got = {}
    for r in R.scoped_applications(seed).collect():
        got.setdefault((r.scope, r.user_id), set()).add(r.application_id)
    assert got == {("STUDENT", 2): {10, 13}, ("STUDENT", 4): {11, 14}, ("STUDENT", 6): {12},
                   ("COMPANY", 3): {10, 11, 13, 14}, ("COMPANY", 5): {12},
                   ("ADMIN", None): {10, 11, 12, 13, 14}}


def test_stage_timeline_labels(seed):
    got = {r.application_id: (r.shortlist_stage, r.interview_label, r.offer_label)
           for r in R.stage_timeline(seed).collect()}
    assert got[10] == (R.STAGE_PENDING, "2 interview records", R.NO_OFFER)
    assert got[12] == (R.STAGE_REACHED, "1 interview record", "Pending")
    assert got[11] == (R.STAGE_NOT_REACHED, R.NO_INTERVIEW, R.NO_OFFER)


def test_audits_find_the_planted_violations(seed):
    found = {(r.rule, r.table_name, r.key) for r in K.audit_all(seed, ).collect()}
    assert ("unique_duplicate", "application", "2|1") in found
    assert ("fk_missing", "interview", "i4") in found
    assert ("check_failed", "certification", "101") in found
    assert ("recruiter_company", "job", "5") in found
    assert not any(k == "100" for _, _, k in found)  # NULL expiry passes the CHECK


def test_scoped_status_update(seed):
    got = {r.application_id: r.status for r in
           M.scoped_status_update(seed.application, seed.job, seed.status_change).collect()}
    assert got == {10: "Selected", 11: "Rejected", 12: "Rejected", 13: "Shortlisted", 14: "Applied"}


def test_cascade_delete_blocks_and_cascades(seed):
    doomed = seed.spark.createDataFrame([(2,), (4,)], "student_id bigint")
    tables = {n: seed.table(n) for n in
              ("student", "student_skill", "certification", "application", "user_account")}
    out, blocked = M.cascade_delete(tables, "student", doomed)
    assert {(r.student_id, r.blocked_by) for r in blocked.collect()} == {(2, "application")}
    assert sorted(r.student_id for r in out["student"].collect()) == [1, 2, 3]
    assert 8 not in {r.user_id for r in out["user_account"].collect()}
    assert out["student_skill"].count() == seed.student_skill.count()


def test_null_update_overwrites(seed):
    ch = seed.spark.createDataFrame([(1, None)], "company_id bigint, website string")
    out = {r.company_id: r.website for r in
           M.apply_updates(seed.company, ch, ["company_id"], ["website"]).collect()}
    assert out == {1: None, 2: None}


def test_changes_are_idempotent(seed):
    targets = seed.job.where(F.col("job_id") == 3)
    once = M.soft_close(seed.job, targets, ["job_id"], "status", "Closed")
    twice = M.soft_close(once, targets, ["job_id"], "status", "Closed")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    gone = seed.certification.where(F.col("certification_id") == 101)
    d1 = M.apply_deletes(seed.certification, gone, ["certification_id"])
    d2 = M.apply_deletes(d1, gone, ["certification_id"])
    assert d1.count() == d2.count() == 1


def test_replace_set_and_upsert(seed):
    new = seed.spark.createDataFrame([(1, 4), (1, 4), (3, 2)], "job_id bigint, skill_id bigint")
    got = sorted(map(tuple, M.replace_set(seed.job_skill, new, ["job_id"]).collect()))
    assert got == [(1, 4), (2, 3), (3, 2)]
    batch = seed.spark.createDataFrame(
        [(2, "asha@new.example", "STUDENT", 1, None), (10, "eve@uni.example", "STUDENT", 5, None)],
        seed.user_account.schema)
    up = {r.user_id: (r.email, r.role) for r in
          M.upsert_partial(seed.user_account, batch, ["user_id"], "email").collect()}
    assert up[2] == ("asha@new.example", "STUDENT") and up[10] == ("eve@uni.example", "STUDENT")
    assert len(up) == 8


def test_missing_skills_inline_and_join_forms_agree(seed, monkeypatch):
    p = seed.spark.createDataFrame([(s, j) for s in (1, 2, 3, 4) for j in (1, 2, 3, 4, 5)],
                                   "student_id bigint, job_id bigint")

    def run():
        return sorted((r.student_id, r.job_id, tuple(r.reasons), tuple(r.missing_skills))
                      for r in E.eligibility_pairs(seed, p, AS_OF).collect())
    inline = run()
    joined = {(r.student_id, r.job_id): tuple(r.missing_skills)
              for r in E.missing_skills(seed, p).collect()}
    assert {(s, j): m for s, j, _, m in inline if m} == joined
    assert (2, 2, (E.REASON_CGPA, E.REASON_MISSING + "Java"), ("Java",)) in inline


def test_counts_make_no_pairs(seed):
    """The counts join students and jobs through their skill sets only."""
    for name in ("eligible_students_per_job", "eligible_jobs_per_student", "skill_holders_per_job"):
        plan = getattr(EC, name)(seed)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            assert not ("Join" in line and "student_id" in line and "job_id" in line.split("student_id", 1)[1])


def test_updates_keep_one_row_per_key(seed):
    """Several changes of one key, repeated and missing keys: rows never multiply or vanish."""
    c = seed.company.first()
    edit = [(c.company_id, f"N{k}", k) for k in (1, 3, 2)]
    ch = seed.spark.createDataFrame(edit, "company_id bigint, company_name string, form_id bigint")
    out = M.apply_updates(seed.company, ch, ["company_id"], ["company_name"], ["form_id"]).collect()
    assert len(out) == seed.company.count()
    assert [r.company_name for r in out if r.company_id == c.company_id] == ["N3"]
    new = seed.spark.createDataFrame([(7001, "X"), (7001, "Y"), (None, "Z"), (1, "W")], "skill_id bigint, skill_name string")
    first, refused = M.split_inserts(seed.skill, new, ["skill_id"])
    assert [tuple(r) for r in first.collect()] == [(7001, "X")]
    assert sorted((r.skill_name, r.refused) for r in refused.collect()) == [
        ("W", "key exists"), ("Y", "key appears earlier in the batch"), ("Z", "key is missing")]
    acc = seed.user_account.first()
    rows = [(acc.user_id, "a@x", "STUDENT", 1, None), (acc.user_id, "b@x", "STUDENT", 1, None),
            (8001, "c@x", "STUDENT", 2, None), (8001, "d@x", "STUDENT", 2, None)]
    up = M.upsert_partial(seed.user_account, seed.spark.createDataFrame(rows, seed.user_account.schema),
                          ["user_id"], "email").collect()
    assert len(up) == seed.user_account.count() + 1
    assert {r.user_id: r.email for r in up if r.user_id in (acc.user_id, 8001)} == {acc.user_id: "b@x", 8001: "d@x"}


def test_window_form_limits_groups_before_the_shuffle(seed):
    """row_number() = 1 per application keeps one row per map partition
    before the exchange (partial WindowGroupLimit), so a hot application does
    not ship all its interviews to one task."""
    plan = R.latest_interview_window(seed)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
