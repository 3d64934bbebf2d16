"""Oracle SQL (DuckDB) for the domain operators: eligibility, reports, audits,
intake, changes. Written in the plain per-row shape of the reference
(correlated NOT EXISTS, count match, window row_number) so that each check
compares two different formulations.
"""

from __future__ import annotations

from ..operators import eligibility as E

AS_OF = f"DATE '{E.DEFAULT_AS_OF}'"


def decide_sql(pairs: str) -> str:
    """E1 over CTE ``pairs`` (request_id, student_id, job_id) -> CTE body."""
    return f"""
    SELECT b.request_id, b.student_id, b.job_id,
           concat_ws(' | ',
             CASE WHEN s.cgpa_x100 < j.min_cgpa_x100 THEN '{E.REASON_CGPA}' END,
             CASE WHEN m.missing IS NOT NULL THEN '{E.REASON_MISSING}' || m.missing END,
             CASE WHEN j.status <> 'Open' OR {AS_OF} > j.application_deadline
                  THEN '{E.REASON_CLOSED}' END) AS reasons_text,
           coalesce(m.missing, '') AS missing_text,
           (s.cgpa_x100 >= j.min_cgpa_x100 AND m.missing IS NULL
            AND j.status = 'Open' AND NOT ({AS_OF} > j.application_deadline)) AS eligible,
           EXISTS (SELECT 1 FROM application a
                   WHERE a.student_id = b.student_id AND a.job_id = b.job_id) AS already_applied
    FROM {pairs} b
    JOIN student s ON s.student_id = b.student_id
    JOIN job j ON j.job_id = b.job_id
    LEFT JOIN (
        SELECT p.student_id, p.job_id,
               string_agg(k.skill_name, ', ' ORDER BY k.skill_name) AS missing
        FROM (SELECT DISTINCT student_id, job_id FROM {pairs}) p
        JOIN job_skill js ON js.job_id = p.job_id
        JOIN skill k ON k.skill_id = js.skill_id
        WHERE NOT EXISTS (SELECT 1 FROM student_skill ss
                          WHERE ss.student_id = p.student_id AND ss.skill_id = js.skill_id)
        GROUP BY p.student_id, p.job_id) m
      ON m.student_id = b.student_id AND m.job_id = b.job_id"""


_DECISION = f"""
    CASE WHEN eligible AND already_applied THEN '{E.DECISION_ALREADY}'
         WHEN eligible THEN '{E.DECISION_ELIGIBLE}'
         ELSE '{E.DECISION_NOT_ELIGIBLE}' END AS decision"""

_WINNERS = """
    w AS (SELECT request_id, student_id, job_id FROM (
            SELECT *, row_number() OVER (PARTITION BY student_id, job_id
                                         ORDER BY ts NULLS FIRST, request_id) AS rn
            FROM application_request) x WHERE rn = 1)"""

# Pairs decided one by one, with skill sets as lists.
_SETS = f"""posts AS (
            SELECT job_id, min_cgpa_x100, coalesce(need, []) AS need,
                   status = 'Open' AND application_deadline >= {AS_OF} AS taking
            FROM job LEFT JOIN (SELECT job_id, list(DISTINCT skill_id) AS need
                                FROM job_skill JOIN skill USING (skill_id) GROUP BY ALL) USING (job_id)),
        persons AS (
            SELECT student_id, cgpa_x100, coalesce(held, []) AS held
            FROM student LEFT JOIN (SELECT student_id, list(DISTINCT skill_id) AS held
                                    FROM student_skill GROUP BY ALL) USING (student_id))"""

SQL = {
    "eligibility_requests": f"""
        WITH r AS (SELECT request_id, student_id, job_id FROM application_request),
        d AS ({decide_sql('r')})
        SELECT request_id, student_id, job_id, reasons_text, missing_text, eligible,
               already_applied, eligible AND NOT already_applied AS can_apply, {_DECISION}
        FROM d""",
    "skill_holders_per_job": f"""
        WITH {_SETS}
        SELECT job_id, len(need) AS n_skills,
               (SELECT count(*) FROM persons WHERE list_has_all(held, need)) AS students_with_all_skills
        FROM posts""",
    "eligible_students_per_job": f"""
        WITH {_SETS}
        SELECT job_id, count(student_id) AS eligible_students
        FROM posts LEFT JOIN persons ON cgpa_x100 >= min_cgpa_x100 AND list_has_all(held, need)
        WHERE taking GROUP BY ALL""",
    "eligible_jobs_per_student": f"""
        WITH {_SETS}
        SELECT student_id, count(job_id) AS eligible_jobs
        FROM persons LEFT JOIN (FROM posts WHERE taking) ON cgpa_x100 >= min_cgpa_x100 AND list_has_all(held, need)
        GROUP BY ALL""",
    "student_cgpa_ranks": """
        SELECT student_id, cgpa_x100, row_number() OVER (ORDER BY cgpa_x100 DESC NULLS LAST, student_id) AS place,
               dense_rank() OVER (ORDER BY cgpa_x100 DESC NULLS LAST) AS cgpa_rank
        FROM student""",
    "cgpa_rank_intervals": """
        SELECT j.job_id, j.min_cgpa_x100, nullif(count(s.student_id), 0) AS last_place,
               arg_min(s.student_id, (-s.cgpa_x100, s.student_id)) AS first_student_id,
               arg_max(s.student_id, (-s.cgpa_x100, s.student_id)) AS last_student_id,
               nullif(count(DISTINCT s.cgpa_x100), 0) AS last_rank
        FROM job j LEFT JOIN student s ON s.cgpa_x100 >= j.min_cgpa_x100
        WHERE j.status = 'Open' AND j.min_cgpa_x100 IS NOT NULL GROUP BY j.job_id, j.min_cgpa_x100""",
    "eligible_counts": """
        SELECT j.job_id, j.min_cgpa_x100, count(s.student_id) AS eligible_students
        FROM job j LEFT JOIN student s ON s.cgpa_x100 >= j.min_cgpa_x100
        WHERE j.status = 'Open' GROUP BY j.job_id, j.min_cgpa_x100""",
    "admit_accepted": f"""
        WITH {_WINNERS.strip()},
        d AS ({decide_sql('w')})
        SELECT (SELECT coalesce(max(application_id), 0) FROM application)
                 + row_number() OVER (ORDER BY r.ts NULLS FIRST, request_id) AS application_id,
               d.student_id, d.job_id, {AS_OF} AS application_date, 'Applied' AS status, request_id
        FROM d JOIN application_request r USING (request_id) WHERE eligible AND NOT already_applied""",
    "admit_rejected": f"""
        WITH {_WINNERS.strip()},
        d AS ({decide_sql('w')})
        SELECT request_id, student_id, job_id,
               CASE WHEN eligible THEN '{E.REASON_APPLIED}' ELSE reasons_text END AS reasons_text
        FROM d WHERE NOT (eligible AND NOT already_applied)
        UNION ALL
        SELECT request_id, student_id, job_id, '{E.REASON_DUPLICATE}'
        FROM application_request WHERE request_id NOT IN (SELECT request_id FROM w)
        UNION ALL
        SELECT request_id, student_id, job_id, '{E.REASON_NOT_FOUND}'
        FROM w WHERE request_id NOT IN (SELECT request_id FROM d)""",
}
