"""Oracle SQL (DuckDB) for the snapshot jobs: each UPDATE / DELETE / INSERT
of the reference written as the SELECT of the table it would leave behind.
"""

from __future__ import annotations

import re

from ..operators import changesets as CS
from ..operators.eligibility import DEFAULT_AS_OF
from .sql_domain import SQL as DOMAIN
from .sql_intake import SQL as INTAKE
from .sql_intake import _long

AS_OF = f"DATE '{DEFAULT_AS_OF}'"


def _acc(name: str) -> str:
    return f"({INTAKE[f'intake_{name}_accepted']})"


_STUDENT_COLS = "student_id, name, email, dob, cgpa_x100, graduation_year, department_id"
_ACCEPTED_STUDENTS = f"(SELECT {_STUDENT_COLS} FROM {_acc('students')} x)"


_NEW_STUDENT_ACCOUNTS = f"""
    SELECT student_id * 2 AS user_id, email, 'STUDENT' AS role, student_id,
           CAST(NULL AS BIGINT) AS company_id
    FROM {_ACCEPTED_STUDENTS} s"""

_STATUS_AFTER = """
    WITH valid AS (
        SELECT c.application_id, c.status, c.ts, c.change_id
        FROM status_change c
        JOIN application a ON a.application_id = c.application_id
        JOIN job j ON j.job_id = a.job_id
        WHERE c.status IN ('Applied', 'Shortlisted', 'Selected', 'Rejected')
          AND j.company_id = c.company_id),
    last AS (SELECT application_id, status FROM (
        SELECT *, row_number() OVER (PARTITION BY application_id
                                     ORDER BY ts DESC, change_id DESC) AS rn FROM valid) x
        WHERE rn = 1)
    SELECT a.application_id, a.student_id, a.job_id, a.application_date,
           CASE WHEN l.application_id IS NOT NULL THEN l.status ELSE a.status END AS status
    FROM application a LEFT JOIN last l ON l.application_id = a.application_id"""

_COMPANY_EDIT = ", ".join(
    f"CASE WHEN a.company_id IS NOT NULL THEN a.{c} ELSE c.{c} END AS {c}"
    for c in CS.COMPANY_EDIT_COLUMNS)

_JOB_EDIT = ", ".join(
    f"CASE WHEN a.job_id IS NOT NULL THEN a.{c} ELSE j.{c} END AS {c}"
    for c in CS.JOB_EDIT_COLUMNS)

_CERT_DELETES = """
    SELECT certification_id, student_id + certification_id % 2 AS student_id
    FROM certification WHERE expiry_date < issue_date"""

_REG_STUDENT = f"""
    SELECT * FROM student
    UNION ALL
    SELECT * FROM {_ACCEPTED_STUDENTS} s
    WHERE s.student_id NOT IN (SELECT student_id FROM student)"""

_REG_ACCOUNT = f"""
    SELECT * FROM user_account
    UNION ALL
    SELECT * FROM ({_NEW_STUDENT_ACCOUNTS}) n
    WHERE n.user_id NOT IN (SELECT user_id FROM user_account)"""

_REG_SKILLS = f"""
    SELECT * FROM student_skill
    UNION ALL
    SELECT n.student_id, n.skill_id, n.proficiency FROM (
        SELECT a.student_id, {_long('u.x.skill_id')} AS skill_id, u.x.proficiency AS proficiency
        FROM {_acc('students')} a
        JOIN student_form f ON f.form_id = a.form_id,
        unnest(f.skills) AS u(x)) n
    WHERE NOT EXISTS (SELECT 1 FROM student_skill ss
                      WHERE ss.student_id = n.student_id AND ss.skill_id = n.skill_id)"""

_STUDENT_DELETES = f"SELECT student_id FROM ({_REG_STUDENT}) rs WHERE department_id = 3"

_BLOCKED = f"""
    SELECT DISTINCT student_id, 'certification' AS blocked_by FROM certification
    WHERE student_id IN ({_STUDENT_DELETES})
    UNION ALL
    SELECT DISTINCT student_id, 'application' AS blocked_by FROM application
    WHERE student_id IN ({_STUDENT_DELETES})"""

_GONE = f"""
    SELECT student_id FROM ({_STUDENT_DELETES}) d
    WHERE student_id NOT IN (SELECT student_id FROM ({_BLOCKED}) b)"""

def _fresh(table: str, key: str, rows: str, columns: str, order: str = "form_id") -> str:
    """``rows`` under new ids from the highest of ``table`` on."""
    return (f"SELECT (SELECT coalesce(max({key}), 0) FROM {table}) + row_number() OVER (ORDER BY {order}) AS {key}, "
            f"{columns} FROM {rows} x")


def _edited(table: str, key: str, accepted: str, columns: list[str], keep: list[str]) -> str:
    """``table`` with ``columns`` from the accepted edit of the row, if there is one."""
    new = ", ".join(f"CASE WHEN a.{key} IS NOT NULL THEN a.{c} ELSE t.{c} END AS {c}" for c in columns)
    same = ", ".join(f"t.{c}" for c in [key, *keep])
    return (f"SELECT {same}, {new} "
            f"FROM {table} t LEFT JOIN {accepted} a ON a.{key} = t.{key}")


_JOB_COLS = ("company_id, recruiter_id, job_title, job_type, description, location, min_cgpa_x100, "
             "application_deadline, salary, status")
_OFFER_COLS = "application_id, offer_date, job_title, salary, joining_date, offer_status"
_NEW_JOBS = _fresh("job", "job_id", f"(SELECT * EXCLUDE (job_id) FROM {_acc('jobs')} y)", "*")
_NEW_COMPANIES = _fresh("company", "company_id", _acc("company_registrations"),
                        "company_name, industry, location, website, email")
_STUDENT_EDIT = ["name", "email", "dob", "cgpa_x100", "graduation_year", "department_id"]
_APPLIED = f"""SELECT application_id, student_id, job_id, application_date, status FROM application
               UNION ALL SELECT application_id, student_id, job_id, application_date, status
               FROM (SELECT * EXCLUDE (request_id) FROM ({DOMAIN['admit_accepted']}) y) n"""
# The workflow: what the second and third batch see in place of ``application``.
_MOVED = re.sub(r"\bapplication\b", "applied_now", _STATUS_AFTER)
_OFFERS_THEN = _fresh("offer", "offer_id", "(SELECT offer_id AS form_id, * EXCLUDE (offer_id) FROM "
                      + "(" + re.sub(r"\bapplication\b", "moved_now", INTAKE["intake_offers_accepted"]) + ") z)", _OFFER_COLS)

SQL = {
    "snapshot_application_after_apply": _APPLIED,
    "snapshot_company_after_company_registration": f"SELECT * FROM company UNION ALL BY NAME SELECT * FROM ({_NEW_COMPANIES}) n",
    "snapshot_user_account_after_company_registration": f"""
        SELECT * FROM user_account UNION ALL BY NAME
        SELECT company_id * 2 + 1 AS user_id, email, 'COMPANY' AS role, NULL AS student_id, company_id FROM ({_NEW_COMPANIES}) n""",
    "snapshot_student_after_profile_edit": _edited("student", "student_id", _acc("student_edits"), _STUDENT_EDIT, []),
    "snapshot_user_account_after_profile_edit": f"""
        SELECT u.user_id, CASE WHEN u.role = 'STUDENT' AND a.student_id IS NOT NULL THEN a.email ELSE u.email END AS email,
               u.role, u.student_id, u.company_id
        FROM user_account u LEFT JOIN {_acc('student_edits')} a ON a.student_id = u.student_id AND u.role = 'STUDENT'""",
    "snapshot_job_after_posting": f"SELECT * FROM job UNION ALL BY NAME SELECT job_id, {_JOB_COLS} FROM ({_NEW_JOBS}) n",
    "snapshot_job_skill_after_posting": f"""
        SELECT job_id, skill_id FROM job_skill UNION ALL
        SELECT DISTINCT n.job_id, u.skill_id FROM ({_NEW_JOBS}) n JOIN job_form f ON f.form_id = n.form_id, unnest(f.skills) AS u(skill_id)""",
    "snapshot_certification_after_adds": f"""
        SELECT * FROM certification UNION ALL BY NAME
        {_fresh("certification", "certification_id", f"(SELECT certification_id AS form_id, * EXCLUDE (certification_id) FROM {_acc('certifications')} y)",
                "* EXCLUDE (form_id)")}""",
    "snapshot_interview_after_scheduling": f"""
        SELECT * FROM interview UNION ALL BY NAME
        SELECT DISTINCT * FROM {_acc('interviews')} a WHERE interview_id NOT IN (SELECT interview_id FROM interview)""",
    "refused_interview_inserts": f"""
        WITH a AS (SELECT * FROM {_acc('interviews')} y)
        SELECT interview_id, application_id, 'key exists' AS refused FROM interview
        UNION ALL SELECT interview_id, application_id, 'key exists' FROM (SELECT * FROM a UNION ALL SELECT * FROM a) z
        WHERE interview_id IN (SELECT interview_id FROM interview)
        UNION ALL SELECT interview_id, application_id, 'key appears earlier in the batch' FROM a
        WHERE interview_id NOT IN (SELECT interview_id FROM interview)""",
    "snapshot_interview_after_edit": _edited("interview", "interview_id", _acc("interview_edits"), [
        "interview_date", "interview_time", "mode", "interview_status", "remarks"], ["application_id"]),
    "snapshot_offer_after_issue": f"""
        SELECT * FROM offer UNION ALL BY NAME
        {_fresh("offer", "offer_id", f"(SELECT offer_id AS form_id, * EXCLUDE (offer_id) FROM {_acc('offers')} y)", _OFFER_COLS)}""",
    "snapshot_offer_after_edit": _edited("offer", "offer_id", _acc("offer_edits"), [
        "offer_date", "job_title", "salary", "joining_date", "offer_status"], ["application_id"]),
    "versioned_offer_after_workflow": f"""
        WITH applied_now AS ({_APPLIED}), moved_now AS ({_MOVED})
        SELECT * FROM offer UNION ALL BY NAME {_OFFERS_THEN}""",
    "snapshot_student_after_registration": _REG_STUDENT,
    "snapshot_student_skill_after_registration": _REG_SKILLS,
    "snapshot_user_account_after_registration": _REG_ACCOUNT,
    "snapshot_company_after_edit": f"""
        SELECT c.company_id, {_COMPANY_EDIT}
        FROM company c LEFT JOIN {_acc('companies')} a ON a.company_id = c.company_id""",
    "snapshot_user_account_after_company_edit": f"""
        SELECT u.user_id,
               CASE WHEN u.role = 'COMPANY' AND a.company_id IS NOT NULL THEN a.email
                    ELSE u.email END AS email,
               u.role, u.student_id, u.company_id
        FROM user_account u
        LEFT JOIN {_acc('companies')} a ON a.company_id = u.company_id AND u.role = 'COMPANY'""",
    "snapshot_job_after_edit": f"""
        SELECT j.job_id, j.company_id, j.recruiter_id, {_JOB_EDIT}
        FROM job j LEFT JOIN {_acc('jobs')} a ON a.job_id = j.job_id""",
    "snapshot_job_skill_after_edit": f"""
        WITH ok AS (SELECT job_id FROM {_acc('jobs')} a)
        SELECT job_id, skill_id FROM job_skill WHERE job_id NOT IN (SELECT job_id FROM ok)
        UNION ALL
        SELECT DISTINCT f.job_id, u.skill_id
        FROM job_form f, unnest(f.skills) AS u(skill_id)
        WHERE f.job_id IN (SELECT job_id FROM ok)""",
    "snapshot_application_after_status_changes": _STATUS_AFTER,
    "snapshot_interview_after_cancellations": """
        SELECT i.interview_id, i.application_id, i.interview_date, i.interview_time, i.mode,
               CASE WHEN i.interview_status = 'Scheduled' AND EXISTS (
                        SELECT 1 FROM application a WHERE a.application_id = i.application_id
                          AND a.status = 'Rejected')
                    THEN 'Cancelled' ELSE i.interview_status END AS interview_status,
               i.remarks
        FROM interview i""",
    "snapshot_offer_after_withdrawals": f"""
        WITH apps AS ({_STATUS_AFTER})
        SELECT o.offer_id, o.application_id, o.offer_date, o.job_title, o.salary, o.joining_date,
               CASE WHEN o.offer_status = 'Pending' AND EXISTS (
                        SELECT 1 FROM apps a WHERE a.application_id = o.application_id
                          AND a.status <> 'Selected')
                    THEN 'Withdrawn' ELSE o.offer_status END AS offer_status
        FROM offer o""",
    "snapshot_job_after_closures": f"""
        SELECT job_id, company_id, recruiter_id, job_title, job_type, description, location,
               min_cgpa_x100, application_deadline, salary,
               CASE WHEN status = 'Open' AND application_deadline < {AS_OF} THEN 'Closed'
                    ELSE status END AS status
        FROM job""",
    "snapshot_student_skill_after_changes": f"""
        WITH a AS (SELECT * FROM {_acc('student_skills')} x)
        SELECT ss.student_id, ss.skill_id,
               CASE WHEN u.student_id IS NOT NULL THEN u.proficiency ELSE ss.proficiency END
                   AS proficiency
        FROM student_skill ss
        LEFT JOIN (SELECT * FROM a WHERE action = 'update') u
          ON u.student_id = ss.student_id AND u.skill_id = ss.skill_id
        UNION ALL
        SELECT student_id, skill_id, proficiency FROM a WHERE action = 'insert'""",
    "snapshot_certification_after_deletes": f"""
        SELECT * FROM certification c
        WHERE NOT EXISTS (SELECT 1 FROM ({_CERT_DELETES}) r
                          WHERE r.certification_id = c.certification_id
                            AND r.student_id = c.student_id)""",
    "cascade_students_blocked": _BLOCKED,
    "snapshot_student_after_cascade": f"""
        SELECT * FROM ({_REG_STUDENT}) rs WHERE student_id NOT IN ({_GONE})""",
    "snapshot_student_skill_after_cascade": f"""
        SELECT * FROM ({_REG_SKILLS}) rk WHERE student_id NOT IN ({_GONE})""",
    "snapshot_user_account_after_cascade": f"""
        SELECT * FROM ({_REG_ACCOUNT}) u
        WHERE u.student_id IS NULL OR u.student_id NOT IN ({_GONE})""",
    "snapshot_user_account_after_upsert": f"""
        WITH batch AS (
            SELECT company_id * 2 + 1 AS user_id, email, 'COMPANY' AS role,
                   CAST(NULL AS BIGINT) AS student_id, company_id
            FROM {_acc('companies')} c
            UNION ALL {_NEW_STUDENT_ACCOUNTS})
        SELECT u.user_id, CASE WHEN b.user_id IS NOT NULL THEN b.email ELSE u.email END AS email,
               u.role, u.student_id, u.company_id
        FROM user_account u LEFT JOIN batch b ON b.user_id = u.user_id
        UNION ALL
        SELECT * FROM batch WHERE user_id NOT IN (SELECT user_id FROM user_account)""",
    "snapshot_department_after_renumber": f"""
        SELECT department_id + {CS.RENUMBER_DEPARTMENTS_BY} AS department_id, department_name
        FROM department""",
    "snapshot_student_after_renumber": f"""
        SELECT s.student_id, s.name, s.email, s.dob, s.cgpa_x100, s.graduation_year,
               CASE WHEN d.department_id IS NOT NULL
                    THEN s.department_id + {CS.RENUMBER_DEPARTMENTS_BY}
                    ELSE s.department_id END AS department_id
        FROM student s LEFT JOIN department d ON d.department_id = s.department_id""",
}
