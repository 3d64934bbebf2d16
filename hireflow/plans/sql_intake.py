"""Oracle SQL (DuckDB) for batch intake: per-row rule checks with EXISTS
subqueries for the lookups, ``concat_ws`` of CASE texts for the reasons.
"""

from __future__ import annotations

from ..functions import rules as X
from ..operators import intake as V


def _strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def _match(x: str, pattern: str) -> str:
    return f"regexp_full_match({x}, '{pattern}')"


def _int(x: str, kind: str = "INTEGER", pattern: str = X.INT_PATTERN) -> str:
    s = _strip(x)
    return f"CASE WHEN {_match(s, pattern)} THEN TRY_CAST({s} AS {kind}) END"


def _long(x: str) -> str:
    return _int(x, "BIGINT")


def _number(x: str) -> str:
    s = _strip(x)
    return f"CASE WHEN {_match(s, X.DECIMAL_PATTERN)} THEN TRY_CAST({s} AS DECIMAL(38,18)) END"


def _date(x: str) -> str:
    s = _strip(x)
    return (f"CASE WHEN {_match(s, X.DATE_PATTERN)} "
            f"THEN CAST(try_strptime({s}, '%Y-%m-%d') AS DATE) END")


def _time(x: str) -> str:
    s = _strip(x)
    h = f"TRY_CAST(split_part({s}, ':', 1) AS INTEGER)"
    m = f"TRY_CAST(split_part({s}, ':', 2) AS INTEGER)"
    return (f"CASE WHEN {_match(s, X.TIME_PATTERN)} AND {h} < 24 AND {m} < 60 "
            f"THEN {h} * 3600 + {m} * 60 END")


def _email_ok(e: str) -> str:
    return f"coalesce({_match(e, X.EMAIL_PATTERN)}, FALSE)"


def _blank_or(x: str, pattern: str) -> str:
    s = _strip(x)
    return f"coalesce({s} = '' OR {_match(s, pattern)}, TRUE)"


def _in(x: str, values) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def _reasons(rules) -> str:
    return "concat_ws(' | ', " + ", ".join(
        f"CASE WHEN coalesce({cond}, FALSE) THEN '{text}' END" for text, cond in rules) + ")"


def _too_long(**bounds: int) -> list[tuple[str, str]]:
    return [(f"{name} is longer than {n} characters", f"length({col}) > {n}")
            for key, n in bounds.items() for col, name in [key.split("__")]]


def _split(checked: str, rules, accepted_cols: str, once=()) -> tuple[str, str]:
    """``once``: (reason, key, owner). The valid rows come one by one in form order; ``held`` lists what those
    that got in hold, and a row whose key is held (by another owner) gets the reason and holds nothing.
    Rows whose keys no other row claims are in anyway."""
    body = f"f AS ({checked}), r0 AS (SELECT *, {_reasons(rules)} AS reasons_text FROM f)"
    if not once:
        return (f"WITH {body} SELECT {accepted_cols} FROM r0 WHERE reasons_text = ''",
                f"WITH {body} SELECT form_id, reasons_text FROM r0 WHERE reasons_text <> ''")
    if len(once) == 1:
        (text, key, owner), = once
        body += (f", r AS (SELECT * REPLACE (CASE WHEN reasons_text = '' AND row_number() OVER (PARTITION BY reasons_text, {key} "
                 f"ORDER BY form_id) > 1 THEN '{text}' ELSE reasons_text END AS reasons_text) FROM r0)")
        return (f"WITH {body} SELECT {accepted_cols} FROM r WHERE reasons_text = ''",
                f"WITH {body} SELECT form_id, reasons_text FROM r WHERE reasons_text <> ''")
    hold = [f"{{'k': {n}, 'v': CAST(v.{key} AS VARCHAR), 'w': coalesce(CAST(v.{owner or 'form_id'} AS VARCHAR), '#' || v.form_id)}}"
            for n, (_, key, owner) in enumerate(once)]
    clash = "concat_ws(' | ', " + ", ".join(
        f"CASE WHEN len(list_filter(w.held, lambda h: h.k = ({x}).k AND h.v = ({x}).v AND h.w <> ({x}).w)) > 0 THEN '{text}' END"
        for x, (text, _, _) in zip(hold, once, strict=True)) + ")"
    rivals = " OR ".join(f"count(*) OVER (PARTITION BY reasons_text, {key}) > 1" for _, key, _ in once)
    body += f""", claims AS (SELECT *, reasons_text = '' AND ({rivals}) AS contested FROM r0),
        valid AS (SELECT *, row_number() OVER (ORDER BY form_id) AS turn FROM claims WHERE contested),
        walk AS (
          SELECT CAST(0 AS BIGINT) AS turn, '' AS late, CAST([] AS STRUCT(k INTEGER, v VARCHAR, w VARCHAR)[]) AS held
          UNION ALL
          SELECT turn, late, CASE WHEN late = '' THEN list_concat(held, mine) ELSE held END
          FROM (SELECT v.turn, {clash} AS late, w.held, [{', '.join(hold)}] AS mine
                FROM walk w JOIN valid v ON v.turn = w.turn + 1)),
        r AS (SELECT valid.* REPLACE (walk.late AS reasons_text) FROM valid JOIN walk USING (turn)
              UNION ALL SELECT *, 0 FROM claims WHERE NOT contested)"""
    return (f"WITH RECURSIVE {body} SELECT {accepted_cols} FROM r WHERE reasons_text = ''",
            f"WITH RECURSIVE {body} SELECT form_id, reasons_text FROM r WHERE reasons_text <> ''")


_BAD_SALARY = "sal IS NULL OR sal < 0 OR TRY_CAST(sal AS DECIMAL(12,2)) IS NULL"


_students = _split(
    f"""SELECT b.*, {_strip('b.name')} AS n, lower({_strip('b.email')}) AS e,
               {_number('b.cgpa')} AS g, {_int('b.graduation_year')} AS y,
               {_date('b.dob')} AS d, {_long('b.department_id')} AS dep, {_long('b.student_id')} AS id
        FROM student_form b""",
    [(V.R_ID, "id IS NULL"),
     (V.R_ID_TAKEN, "EXISTS (SELECT 1 FROM student s WHERE s.student_id = id)"),
     (V.R_NAME, "n = ''"),
     (V.R_EMAIL, f"NOT {_email_ok('e')}"),
     (V.R_CGPA, "g IS NULL OR g < 0 OR g > 10"),
     (V.R_YEAR, "y IS NULL OR y < 1900 OR y > 2200"),
     (V.R_PHONE, f"NOT {_blank_or('phone', X.PHONE_PATTERN)}"),
     (V.R_DOB, "d IS NULL"),
     (V.R_DEPARTMENT, "NOT EXISTS (SELECT 1 FROM department x WHERE x.department_id = dep)"),
     (V.R_EMAIL_TAKEN, "EXISTS (SELECT 1 FROM user_account u WHERE lower(u.email) = e)"),
     *_too_long(n__name=120, e__email=150),
     (V.R_REG_SKILL, f"EXISTS (SELECT 1 FROM (SELECT unnest(f.skills) AS x) u "
                     f"WHERE NOT EXISTS (SELECT 1 FROM skill k "
                     f"WHERE k.skill_id = {_long('u.x.skill_id')}))"),
     (V.R_REG_PROFICIENCY, "EXISTS (SELECT 1 FROM (SELECT unnest(f.skills) AS x) u "
                           "WHERE coalesce(u.x.proficiency, 'Beginner') NOT IN "
                           "('Beginner', 'Intermediate', 'Advanced'))"),
     (V.R_REG_SKILL_TWICE,
      f"len(list_distinct(list_transform(skills, lambda x: {_strip('x.skill_id')}))) < len(skills)")],
    "form_id, id AS student_id, n AS name, e AS email, d AS dob, "
    "CAST(round(g * 100) AS INTEGER) AS cgpa_x100, y AS graduation_year, dep AS department_id, "
    "array_to_string(list_sort(list_transform(skills, lambda x: x.skill_id || ':' || x.proficiency)), ',') "
    "AS skills_text", [(V.R_EMAIL_TWICE, "e", None), (V.R_ID_TWICE, "id", None)])

_companies = _split(
    f"""SELECT b.*, {_strip('b.company_name')} AS n, {_strip('b.industry')} AS ind,
               {_strip('b.location')} AS loc, lower({_strip('b.email')}) AS e
        FROM company_form b""",
    [(V.R_COMPANY_NAME, "n = ''"),
     (V.R_INDUSTRY, "ind = ''"),
     (V.R_LOCATION, "loc = ''"),
     (V.R_EMAIL, f"NOT {_email_ok('e')}"),
     (V.R_WEBSITE, f"NOT {_blank_or('website', X.WEBSITE_PATTERN)}"),
     (V.R_PHONE, f"NOT {_blank_or('phone', X.PHONE_PATTERN)}"),
     (V.R_EMAIL_OTHER_ACCOUNT,
      "EXISTS (SELECT 1 FROM user_account u WHERE lower(u.email) = e AND (f.user_id IS NULL OR u.user_id <> f.user_id))"),
     (V.R_EMAIL_OTHER_COMPANY,
      "EXISTS (SELECT 1 FROM company c WHERE lower(c.email) = e AND (f.company_id IS NULL OR c.company_id <> f.company_id))"),
     (V.R_NAME_OTHER_COMPANY,
      "EXISTS (SELECT 1 FROM company c WHERE c.company_name = n AND (f.company_id IS NULL OR c.company_id <> f.company_id))"),
     *_too_long(n__company_name=150, ind__industry=100, loc__location=150, e__email=150, website__website=255)],
    f"form_id, company_id, n AS company_name, ind AS industry, loc AS location, "
    f"nullif({_strip('website')}, '') AS website, e AS email",
    [(V.R_COMPANY_EMAIL_TWICE, "e", "company_id"), (V.R_COMPANY_NAME_TWICE, "n", "company_id")])

_jobs = _split(
    f"""SELECT b.form_id, b.job_id, b.company_id, coalesce(b.status, '') AS status, {_long('b.recruiter_id')} AS recruiter_id,
               {_strip('b.job_title')} AS t, {_strip('b.job_type')} AS ty,
               {_strip('b.description')} AS ds, {_strip('b.location')} AS loc,
               {_number('b.minimum_cgpa')} AS m, {_number('b.salary')} AS sal,
               {_date('b.deadline')} AS dl, list_distinct(b.skills) AS skill_set,
               EXISTS (SELECT 1 FROM (SELECT unnest(b.skills) AS sid) u
                       WHERE u.sid NOT IN (SELECT skill_id FROM skill)) AS bad_skill
        FROM job_form b""",
    [(V.R_TITLE, "t = ''"),
     (V.R_TYPE, "ty = ''"),
     (V.R_DESCRIPTION, "ds = ''"),
     (V.R_LOCATION, "loc = ''"),
     (V.R_MIN_CGPA, "m IS NULL OR m < 0 OR m > 10"),
     (V.R_SALARY, _BAD_SALARY),
     (V.R_DEADLINE, "dl IS NULL"),
     (V.R_JOB_STATUS, f"NOT {_in('status', ('Open', 'Closed'))}"),
     (V.R_SKILLS, "bad_skill"),
     (V.R_RECRUITER, "NOT EXISTS (SELECT 1 FROM recruiter x WHERE x.recruiter_id = f.recruiter_id "
                     "AND x.company_id = f.company_id)"),
     *_too_long(t__job_title=150, ty__job_type=50, loc__location=150)],
    "form_id, job_id, company_id, recruiter_id, t AS job_title, ty AS job_type, ds AS description, "
    "loc AS location, CAST(round(m * 100) AS INTEGER) AS min_cgpa_x100, dl AS application_deadline, "
    "CAST(TRY_CAST(sal AS DECIMAL(12,2)) AS DOUBLE) AS salary, status, "
    "array_to_string(list_sort(skill_set), ',') AS skills_text")

_certifications = _split(
    f"""SELECT b.*, {_long('b.student_id')} AS sid, {_strip('b.certification_name')} AS cn,
               {_strip('b.issuing_organization')} AS org, {_date('b.issue_date')} AS iss,
               {_date('b.expiry_date')} AS exp
        FROM certification_form b""",
    [(V.R_CERT_NAME, "cn = ''"),
     (V.R_ORGANIZATION, "org = ''"),
     (V.R_ISSUE, "iss IS NULL"),
     (V.R_EXPIRY, f"{_strip('expiry_date')} <> '' AND exp IS NULL"),
     (V.R_EXPIRY_ORDER, "exp < iss"),
     (V.R_STUDENT, "NOT EXISTS (SELECT 1 FROM student s WHERE s.student_id = sid)"),
     *_too_long(cn__certification_name=150, org__issuing_organization=150)],
    "form_id AS certification_id, sid AS student_id, cn AS certification_name, "
    "org AS issuing_organization, iss AS issue_date, exp AS expiry_date")

_OWNER = """(SELECT j.company_id FROM application a JOIN job j ON j.job_id = a.job_id
             WHERE a.application_id = {aid})"""

def _interviews(form: str) -> tuple[str, str]:
    return _split(
    f"""SELECT b.* REPLACE (coalesce(b.mode, '') AS mode, coalesce(b.interview_status, '') AS interview_status),
               {_long('b.application_id')} AS aid, {_date('b.interview_date')} AS dt,
               {_time('b.interview_time')} AS tm
        FROM {form} b""",
    [(V.R_INTERVIEW_DATE, "dt IS NULL"),
     (V.R_INTERVIEW_TIME, "tm IS NULL"),
     (V.R_MODE, f"NOT {_in('mode', ('Online', 'In-person'))}"),
     (V.R_INTERVIEW_STATUS, f"NOT {_in('interview_status', ('Scheduled', 'Completed', 'Cancelled'))}"),
     (V.R_REMARKS, f"length({_strip('remarks')}) > 500"),
     (V.R_NOT_OWNED, f"NOT coalesce({_OWNER.format(aid='f.aid')} = f.company_id, FALSE)")],
    f"form_id AS interview_id, aid AS application_id, dt AS interview_date, "
    f"tm AS interview_time, mode, interview_status, nullif({_strip('remarks')}, '') AS remarks")

def _offers(form: str, editing: bool) -> tuple[str, str]:
    new = [(V.R_NOT_SELECTED, "EXISTS (SELECT 1 FROM application a JOIN job j ON j.job_id = a.job_id "
                              "WHERE a.application_id = f.aid AND a.status <> 'Selected')"),
           (V.R_OFFER_EXISTS, "EXISTS (SELECT 1 FROM offer o WHERE o.application_id = f.aid)")]
    return _split(
    f"""SELECT b.* REPLACE (coalesce(b.offer_status, '') AS offer_status),
               {_long('b.application_id')} AS aid, {_date('b.offer_date')} AS od,
               {_date('b.joining_date')} AS jd, {_strip('b.job_title')} AS t,
               {_number('b.salary')} AS sal
        FROM {form} b""",
    [(V.R_OFFER_DATE, "od IS NULL"),
     (V.R_JOINING_DATE, "jd IS NULL"),
     (V.R_OFFER_TITLE, "t = ''"),
     (V.R_OFFER_TITLE_LONG, "length(t) > 150"),
     (V.R_SALARY, _BAD_SALARY),
     (V.R_OFFER_STATUS, f"NOT {_in('offer_status', ('Pending', 'Accepted', 'Withdrawn'))}"),
     (V.R_JOINING_ORDER, "jd < od"),
     (V.R_NOT_OWNED, f"NOT coalesce({_OWNER.format(aid='f.aid')} = f.company_id, FALSE)"),
     *([] if editing else new)],
    "form_id AS offer_id, aid AS application_id, od AS offer_date, t AS job_title, "
    "CAST(TRY_CAST(sal AS DECIMAL(12,2)) AS DOUBLE) AS salary, jd AS joining_date, offer_status",
    [] if editing else [(V.R_APP_TWICE, "aid", None)])

_skills = _split(
    f"""SELECT b.form_id, b.student_id, coalesce(b.proficiency, '') AS proficiency,
               coalesce(b.allow_update, FALSE) AS allow_update, {_long('b.skill_id')} AS skill_id,
               EXISTS (SELECT 1 FROM student_skill ss WHERE ss.student_id = b.student_id
                       AND ss.skill_id = {_long('b.skill_id')}) AS held
        FROM student_skill_form b""",
    [(V.R_PROFICIENCY, f"NOT {_in('proficiency', ('Beginner', 'Intermediate', 'Advanced'))}"),
     (V.R_SKILL, "NOT EXISTS (SELECT 1 FROM skill k WHERE k.skill_id = f.skill_id)"),
     (V.R_SKILL_HELD, "held AND NOT allow_update")],
    "student_id, skill_id, proficiency, CASE WHEN held THEN 'update' ELSE 'insert' END AS action",
    [(V.R_SKILL_TWICE, "student_id, skill_id", None)])

_student_edits = _split(
    f"""SELECT b.form_id, b.form_id AS student_id, b.phone, {_strip('b.name')} AS n, lower({_strip('b.email')}) AS e,
               {_number('b.cgpa')} AS g, {_int('b.graduation_year')} AS y, {_date('b.dob')} AS d, {_long('b.department_id')} AS dep
        FROM student_form b""",
    [(V.R_STUDENT, "NOT EXISTS (SELECT 1 FROM student s WHERE s.student_id = f.student_id)"),
     (V.R_NAME, "n = ''"),
     (V.R_EMAIL, f"NOT {_email_ok('e')}"),
     (V.R_CGPA, "g IS NULL OR g < 0 OR g > 10"),
     (V.R_YEAR, "y IS NULL OR y < 1900 OR y > 2200"),
     (V.R_PHONE, f"NOT {_blank_or('phone', X.PHONE_PATTERN)}"),
     (V.R_DOB, "d IS NULL"),
     (V.R_DEPARTMENT, "NOT EXISTS (SELECT 1 FROM department x WHERE x.department_id = dep)"),
     (V.R_EMAIL_OTHER_ACCOUNT, "EXISTS (SELECT 1 FROM user_account u WHERE lower(u.email) = e AND u.user_id <> f.form_id * 2)"),
     *_too_long(n__name=120, e__email=150)],
    "form_id, student_id, n AS name, e AS email, d AS dob, CAST(round(g * 100) AS INTEGER) AS cgpa_x100, "
    "y AS graduation_year, dep AS department_id", [(V.R_EMAIL_TWICE, "e", None)])

_registrations = _split(
    f"""SELECT b.*, {_strip('b.company_name')} AS n, {_strip('b.industry')} AS ind, {_strip('b.location')} AS loc,
               lower({_strip('b.email')}) AS e
        FROM company_registration_form b""",
    [(V.R_COMPANY_NAME, "company_name IS NULL"), (V.R_INDUSTRY, "industry IS NULL"),
     (V.R_LOCATION, "location IS NULL"), (V.R_EMAIL, "email IS NULL"),
     (V.R_EMAIL_TAKEN, "e IN (SELECT lower(email) FROM user_account) OR e IN (SELECT lower(email) FROM company)"),
     (V.R_NAME_OTHER_COMPANY, "n IN (SELECT company_name FROM company)"),
     *_too_long(n__company_name=150, ind__industry=100, loc__location=150, e__email=150, website__website=255)],
    "form_id, n AS company_name, ind AS industry, loc AS location, website, e AS email",
    [(V.R_EMAIL_TWICE, "e", None), (V.R_NAME_TWICE, "n", None)])

SQL = {}
for _name, (_acc, _quar) in {"students": _students, "companies": _companies, "jobs": _jobs,
                             "certifications": _certifications, "interviews": _interviews("interview_form"),
                             "offers": _offers("offer_form", False), "student_skills": _skills,
                             "student_edits": _student_edits, "company_registrations": _registrations,
                             "interview_edits": _interviews("interview_edit_form"),
                             "offer_edits": _offers("offer_edit_form", True)}.items():
    SQL[f"intake_{_name}_accepted"] = _acc
    SQL[f"intake_{_name}_quarantined"] = _quar
