"""Oracle SQL (DuckDB) for the catalogue queries, over the bound domain CTEs.

Each text states what a query must return, in its own terms: the fact tables are read
through one wide relation, counts are made before anything is joined to them, the
division is a count of covered skills, and extremes are window values.
``oracle.with_binding`` adds the domain definitions.
"""

from __future__ import annotations

from ..operators import catalogue as C

#: Every application with the names of its student and job and the job's company.
PLACED = """(FROM application
    JOIN (SELECT student_id, name AS student_name, department_id FROM student) USING (student_id)
    JOIN (SELECT job_id, job_title, company_id FROM job) USING (job_id)
    SELECT application_id, student_name, job_title, company_id, department_id, status)"""


def _per(parent: str, key: str, child: str, label: str, count: str, at_least: int) -> str:
    """Rows of ``parent`` with the number of its ``child`` rows, counted before the join."""
    keep = f"WHERE coalesce(n, 0) >= {at_least}" if at_least else ""
    return f"""
        SELECT {label}, coalesce(n, 0) AS {count}
        FROM {parent} LEFT JOIN (SELECT {key}, count(*) AS n FROM {child} GROUP BY ALL) USING ({key}) {keep}"""


def _with_status(status: str) -> str:
    return f"SELECT student_name, job_title, status FROM {PLACED} WHERE status = '{status}'"


def _tracking(department: str, company: str) -> str:
    return f"""
        WITH outcome AS (
            SELECT application_id, interview_status, offer_status
            FROM (SELECT application_id FROM application)
            LEFT JOIN interview USING (application_id) LEFT JOIN offer USING (application_id))
        SELECT student_name, {department} job_title, {company}, status AS application_status,
               interview_status, offer_status
        FROM outcome JOIN {PLACED} USING (application_id)
        JOIN (SELECT company_id, company_name FROM company) USING (company_id)
        JOIN (SELECT department_id, department_name FROM department) USING (department_id)"""


SQL = {
    "q01_students": "SELECT * FROM student",
    "q02_students_cgpa_ge": f"SELECT * FROM student WHERE cgpa_x100 >= {C.HIGH_CGPA_X100}",
    "q03_students_of_department": f"""
        SELECT * FROM student WHERE department_id IN (
            SELECT department_id FROM department WHERE department_name = '{C.CSE_DEPARTMENT}')""",
    "q04_open_jobs": "SELECT * FROM job WHERE status = 'Open'",
    "q05_jobs_min_cgpa_le": f"SELECT * FROM job WHERE min_cgpa_x100 <= {C.MAX_MIN_CGPA_X100}",
    "q06_companies": "SELECT * FROM company",
    "q07_skills": "SELECT * FROM skill",
    "q08_students_by_cgpa": "SELECT student_id, name, cgpa_x100 FROM student ORDER BY cgpa_x100 DESC",
    "q09_jobs_by_salary": "SELECT job_id, job_title, salary FROM job ORDER BY salary DESC",
    "q10_jobs_at_location": f"SELECT * FROM job WHERE location = '{C.JOB_LOCATION}'",
    "q11_selected_applications": "SELECT * FROM application WHERE status = 'Selected'",
    "q12_shortlisted_applications": "SELECT * FROM application WHERE status = 'Shortlisted'",
    "q13_students_name_prefix": f"SELECT * FROM student WHERE name LIKE '{C.NAME_PREFIX}%'",
    "q14_jobs_salary_between": f"SELECT * FROM job WHERE salary BETWEEN {C.SALARY_LOW} AND {C.SALARY_HIGH}",
    "q15_student_department": """
        SELECT name AS student_name, department_name
        FROM department JOIN (SELECT department_id, name FROM student) USING (department_id)""",
    "q16_job_company_recruiter": """
        SELECT job_title, company_name, recruiter_name
        FROM (SELECT company_id, company_name FROM company)
        JOIN (SELECT job_title, company_id, recruiter_id FROM job) USING (company_id)
        JOIN (SELECT recruiter_id, recruiter_name FROM recruiter) USING (recruiter_id)""",
    "q17_application_status": f"SELECT student_name, job_title, status AS application_status FROM {PLACED}",
    "q18_student_skills": """
        SELECT name AS student_name, skill_name, proficiency
        FROM skill JOIN student_skill USING (skill_id) JOIN (SELECT student_id, name FROM student) USING (student_id)""",
    "q19_job_required_skills": """
        SELECT job_title, skill_name AS required_skill
        FROM skill JOIN job_skill USING (skill_id) JOIN (SELECT job_id, job_title FROM job) USING (job_id)""",
    "q20_student_certifications": """
        SELECT name AS student_name, certification_name, issuing_organization
        FROM (SELECT student_id, name FROM student) JOIN certification USING (student_id)""",
    "q21_interview_schedule": f"""
        SELECT student_name, job_title, interview_date, interview_status
        FROM {PLACED} JOIN interview USING (application_id)""",
    "q22_offers": f"""
        SELECT student_name, p.job_title, salary, offer_status
        FROM {PLACED} p JOIN (SELECT application_id, salary, offer_status FROM offer) USING (application_id)""",
    "q23_students_per_department": _per("department", "department_id", "student", "department_id, department_name", "student_count", 0),
    "q24_jobs_per_company": _per("company", "company_id", "job", "company_id, company_name", "job_count", 0),
    "q25_applications_per_job": _per("job", "job_id", "application", "job_id, job_title", "application_count", 0),
    "q26_average_cgpa": "SELECT round(avg(cgpa_x100) / 100, 6) AS average_student_cgpa FROM student",
    "q27_highest_cgpa": "SELECT max(cgpa_x100) AS highest_student_cgpa_x100 FROM student",
    "q28_lowest_cgpa": "SELECT min(cgpa_x100) AS lowest_student_cgpa_x100 FROM student",
    "q29_average_salary": "SELECT round(avg(salary), 6) AS average_job_salary FROM job",
    "q30_applications_by_status": """
        SELECT status, count(*) AS application_count FROM application GROUP BY status""",
    "q31_departments_with_students": _per("department", "department_id", "student", "department_name", "student_count", 2),
    "q32_jobs_with_applications": _per("job", "job_id", "application", "job_title", "application_count", 2),
    "q33_companies_with_jobs": _per("company", "company_id", "job", "company_name", "job_count", 2),
    "q34_statuses_with_applications": """
        SELECT DISTINCT status, n AS application_count
        FROM (SELECT status, count(*) OVER (PARTITION BY status) AS n FROM application) WHERE n > 1""",
    "q35_students_above_average": """
        SELECT student_id, name, cgpa_x100 FROM student QUALIFY cgpa_x100 > avg(cgpa_x100) OVER ()""",
    "q36_jobs_above_average": "SELECT job_id, job_title, salary FROM job QUALIFY salary > avg(salary) OVER ()",
    "q37_students_who_applied": """
        SELECT student_id, name FROM student
        WHERE student_id IN (SELECT student_id FROM application)""",
    "q38_students_never_applied": """
        SELECT student_id, name FROM student
        WHERE student_id NOT IN (SELECT student_id FROM application)""",
    "q39_students_with_top_cgpa": """
        SELECT student_id, name, cgpa_x100 FROM student QUALIFY rank() OVER (ORDER BY cgpa_x100 DESC) = 1""",
    "q40_cgpa_check_pair": f"""
        WITH asked AS (SELECT {C.PAIR_STUDENT} AS student_id, {C.PAIR_JOB} AS job_id)
        SELECT name AS student_name, cgpa_x100, job_title, min_cgpa_x100,
               if(cgpa_x100 < min_cgpa_x100, 'Not Eligible', 'Eligible') AS cgpa_eligibility
        FROM asked JOIN (SELECT student_id, name, cgpa_x100 FROM student) USING (student_id)
        JOIN (SELECT job_id, job_title, min_cgpa_x100 FROM job) USING (job_id)""",
    "q41_students_with_all_skills": f"""
        WITH needed AS (SELECT skill_id FROM job_skill WHERE job_id = {C.DIVISION_JOB}),
        covered AS (SELECT student_id, count(DISTINCT skill_id) AS n
                    FROM student_skill JOIN needed USING (skill_id) GROUP BY ALL)
        SELECT student_id, name FROM student LEFT JOIN covered USING (student_id)
        WHERE coalesce(n, 0) = (SELECT count(DISTINCT skill_id) FROM needed)""",
    "q42_cgpa_report_open_jobs": """
        SELECT j.job_id, j.job_title, j.min_cgpa_x100,
               count(s.student_id) AS eligible_students,
               (SELECT count(*) FROM student) - count(s.student_id) AS not_eligible_students
        FROM job j LEFT JOIN student s ON s.cgpa_x100 >= j.min_cgpa_x100
        WHERE j.status = 'Open'
        GROUP BY j.job_id, j.job_title, j.min_cgpa_x100""",
    "q44_shortlisted": _with_status("Shortlisted"),
    "q45_selected": _with_status("Selected"),
    "q46_rejected": _with_status("Rejected"),
    "q48_scheduled_interviews": f"""
        SELECT student_name, job_title, interview_date, interview_status
        FROM (SELECT * FROM interview WHERE interview_status = 'Scheduled') JOIN {PLACED} USING (application_id)""",
    "q49_tracking_report": _tracking("", "company_name"),
    "q50_application_lookup": f"SELECT * FROM application WHERE application_id = {C.LOOKUP_APPLICATION}",
    "q51_student_lookup": f"SELECT * FROM student WHERE student_id = {C.LOOKUP_STUDENT}",
    "q52_job_lookup": f"SELECT * FROM job WHERE job_id = {C.LOOKUP_JOB}",
    "q53_certification_lookup": f"SELECT * FROM certification WHERE certification_id = {C.LOOKUP_CERTIFICATION}",
    "q54_certifications_after_delete": f"""
        SELECT * FROM certification WHERE certification_id <> {C.LOOKUP_CERTIFICATION}""",
    "q55_total_students": "SELECT count(*) AS total_students FROM student",
    "q56_total_companies": "SELECT count(*) AS total_companies FROM company",
    "q57_total_jobs": "SELECT count(*) AS total_jobs FROM job",
    "q58_total_applications": "SELECT count(*) AS total_applications FROM application",
    "q59_total_selected_students": """
        SELECT count(DISTINCT student_id) AS total_selected_students
        FROM application WHERE status = 'Selected'""",
    "q60_total_offers": "SELECT count(*) AS total_offers FROM offer",
    "q61_open_jobs": "SELECT count(*) AS open_jobs FROM job WHERE status = 'Open'",
    "q63_workflow_report": _tracking("department_name AS department,", "company_name AS company"),
}
# These queries ask again what an earlier one asked.
SQL["q43_application_status"] = SQL["q17_application_status"]
SQL["q47_offers_received"] = SQL["q22_offers"]
SQL["q62_applications_by_status"] = SQL["q30_applications_by_status"]
