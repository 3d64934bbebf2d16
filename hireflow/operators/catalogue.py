"""The numbered catalogue: selections, joins, aggregates, subqueries, division.

One function per catalogue query (``q01`` .. ``q63``), each ``(T, **literals)
-> DataFrame`` with the reference's literals re-bound to the bound domain
(CGPA in hundredths, nation names as departments/locations, supplier rows as
companies). Joins are plain equi-joins: Catalyst pushes the filters below them
and prunes columns down to the parquet scan; AQE picks broadcast or sort-merge
from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Literal bindings of the catalogue on the bound domain.
HIGH_CGPA_X100 = 800
CSE_DEPARTMENT = "NATION_3"
MAX_MIN_CGPA_X100 = 800
JOB_LOCATION = "NATION_7"
NAME_PREFIX = "Customer#0000001"
SALARY_LOW, SALARY_HIGH = 925.0, 950.0
PAIR_STUDENT, PAIR_JOB = 2, 1        # Q40
DIVISION_JOB = 12                    # Q41 (a job with three required skills)
LOOKUP_APPLICATION = 2               # Q50
LOOKUP_STUDENT = 2                   # Q51
LOOKUP_JOB = 6                       # Q52
LOOKUP_CERTIFICATION = 20            # Q53


def _cgpa_label(cgpa, minimum):
    return F.when(cgpa >= minimum, "Eligible").otherwise("Not Eligible")


# Section 1: basic selection -------------------------------------------------
def q01_students(T) -> DataFrame:
    return T.student


def q02_students_cgpa_ge(T, min_x100: int = HIGH_CGPA_X100) -> DataFrame:
    return T.student.where(F.col("cgpa_x100") >= min_x100)


def q03_students_of_department(T, department: str = CSE_DEPARTMENT) -> DataFrame:
    d = T.department.where(F.col("department_name") == department)
    return T.student.join(d.select("department_id"), "department_id", "left_semi")


def q04_open_jobs(T) -> DataFrame:
    return T.job.where(F.col("status") == "Open")


def q05_jobs_min_cgpa_le(T, max_x100: int = MAX_MIN_CGPA_X100) -> DataFrame:
    return T.job.where(F.col("min_cgpa_x100") <= max_x100)


def q06_companies(T) -> DataFrame:
    return T.company


def q07_skills(T) -> DataFrame:
    return T.skill


# Section 2: order and filter -----------------------------------------------
def q08_students_by_cgpa(T) -> DataFrame:
    return (T.student.select("student_id", "name", "cgpa_x100")
            .orderBy(F.desc("cgpa_x100"), "student_id"))


def q09_jobs_by_salary(T) -> DataFrame:
    return (T.job.select("job_id", "job_title", "salary")
            .orderBy(F.desc("salary"), "job_id"))


def q10_jobs_at_location(T, location: str = JOB_LOCATION) -> DataFrame:
    return T.job.where(F.col("location") == location)


def q11_selected_applications(T) -> DataFrame:
    return T.application.where(F.col("status") == "Selected")


def q12_shortlisted_applications(T) -> DataFrame:
    return T.application.where(F.col("status") == "Shortlisted")


def q13_students_name_prefix(T, prefix: str = NAME_PREFIX) -> DataFrame:
    # startswith is pushed to the parquet scan as a StringStartsWith filter.
    return T.student.where(F.col("name").startswith(prefix))


def q14_jobs_salary_between(T, low: float = SALARY_LOW, high: float = SALARY_HIGH) -> DataFrame:
    return T.job.where(F.col("salary").between(low, high))


# Section 3: joins ------------------------------------------------------------
def q15_student_department(T) -> DataFrame:
    return (T.student.join(T.department, "department_id")
            .select(F.col("name").alias("student_name"), "department_name"))


def q16_job_company_recruiter(T) -> DataFrame:
    return (T.job.join(T.company, "company_id")
            .join(T.recruiter.drop("company_id"), "recruiter_id")
            .select("job_title", "company_name", "recruiter_name"))


def _application_people(T, app: DataFrame | None = None) -> DataFrame:
    app = T.application if app is None else app
    return (app.join(T.student.select("student_id", "name"), "student_id")
               .join(T.job.select("job_id", "job_title"), "job_id"))


def q17_application_status(T) -> DataFrame:
    return _application_people(T).select(
        F.col("name").alias("student_name"), "job_title",
        F.col("status").alias("application_status"))


def q18_student_skills(T) -> DataFrame:
    return (T.student_skill.join(T.student.select("student_id", "name"), "student_id")
            .join(T.skill, "skill_id")
            .select(F.col("name").alias("student_name"), "skill_name", "proficiency"))


def q19_job_required_skills(T) -> DataFrame:
    return (T.job_skill.join(T.job.select("job_id", "job_title"), "job_id")
            .join(T.skill, "skill_id")
            .select("job_title", F.col("skill_name").alias("required_skill")))


def q20_student_certifications(T) -> DataFrame:
    return (T.certification.join(T.student.select("student_id", "name"), "student_id")
            .select(F.col("name").alias("student_name"), "certification_name",
                    "issuing_organization"))


def q21_interview_schedule(T) -> DataFrame:
    i = T.interview.select("application_id", "interview_date", "interview_status")
    return (_application_people(T).join(i, "application_id")
            .select(F.col("name").alias("student_name"), "job_title", "interview_date",
                    "interview_status"))


def q22_offers(T) -> DataFrame:
    o = T.offer.select("application_id", "salary", "offer_status")
    return (_application_people(T).join(o, "application_id")
            .select(F.col("name").alias("student_name"), "job_title", "salary",
                    "offer_status"))


# Section 4: aggregates -------------------------------------------------------
def q23_students_per_department(T) -> DataFrame:
    # Pre-aggregate the fact side, then join the dimension: the shuffle carries
    # one row per department instead of one per student.
    n = T.student.groupBy("department_id").agg(F.count("student_id").alias("student_count"))
    return (T.department.join(n, "department_id", "left")
            .select("department_id", "department_name",
                    F.coalesce("student_count", F.lit(0)).alias("student_count")))


def q24_jobs_per_company(T) -> DataFrame:
    n = T.job.groupBy("company_id").agg(F.count("job_id").alias("job_count"))
    return (T.company.join(n, "company_id", "left")
            .select("company_id", "company_name",
                    F.coalesce("job_count", F.lit(0)).alias("job_count")))


def q25_applications_per_job(T) -> DataFrame:
    n = T.application.groupBy("job_id").agg(F.count("application_id").alias("application_count"))
    return (T.job.join(n, "job_id", "left")
            .select("job_id", "job_title",
                    F.coalesce("application_count", F.lit(0)).alias("application_count")))


def q26_average_cgpa(T) -> DataFrame:
    return T.student.agg(F.round(F.avg("cgpa_x100") / 100, 6).alias("average_student_cgpa"))


def q27_highest_cgpa(T) -> DataFrame:
    return T.student.agg(F.max("cgpa_x100").alias("highest_student_cgpa_x100"))


def q28_lowest_cgpa(T) -> DataFrame:
    return T.student.agg(F.min("cgpa_x100").alias("lowest_student_cgpa_x100"))


def q29_average_salary(T) -> DataFrame:
    return T.job.agg(F.round(F.avg("salary"), 6).alias("average_job_salary"))


def q30_applications_by_status(T) -> DataFrame:
    return T.application.groupBy("status").agg(F.count(F.lit(1)).alias("application_count"))


# Section 5: group by + having ----------------------------------------------
def q31_departments_with_students(T, more_than: int = 1) -> DataFrame:
    n = T.student.groupBy("department_id").agg(F.count("student_id").alias("student_count"))
    return (n.where(F.col("student_count") > more_than)
            .join(T.department, "department_id")
            .select("department_name", "student_count"))


def q32_jobs_with_applications(T, more_than: int = 1) -> DataFrame:
    n = T.application.groupBy("job_id").agg(F.count("application_id").alias("application_count"))
    return (n.where(F.col("application_count") > more_than)
            .join(T.job.select("job_id", "job_title"), "job_id")
            .select("job_title", "application_count"))


def q33_companies_with_jobs(T, more_than: int = 1) -> DataFrame:
    n = T.job.groupBy("company_id").agg(F.count("job_id").alias("job_count"))
    return (n.where(F.col("job_count") > more_than)
            .join(T.company.select("company_id", "company_name"), "company_id")
            .select("company_name", "job_count"))


def q34_statuses_with_applications(T, more_than: int = 1) -> DataFrame:
    return (q30_applications_by_status(T)
            .where(F.col("application_count") > more_than))


# Section 6: subqueries -------------------------------------------------------
def q35_students_above_average(T) -> DataFrame:
    # Uncorrelated scalar subquery: Spark runs it once and feeds the value
    # into the filter of the outer scan.
    s = T.student
    avg = s.agg(F.avg("cgpa_x100")).scalar()
    return s.where(F.col("cgpa_x100") > avg).select("student_id", "name", "cgpa_x100")


def q36_jobs_above_average(T) -> DataFrame:
    j = T.job
    avg = j.agg(F.avg("salary")).scalar()
    return j.where(F.col("salary") > avg).select("job_id", "job_title", "salary")


def q37_students_who_applied(T) -> DataFrame:
    return (T.student.join(T.application.select("student_id"), "student_id", "left_semi")
            .select("student_id", "name"))


def q38_students_never_applied(T) -> DataFrame:
    # NOT IN over a NOT NULL column is an anti join; written as one, so Spark
    # can use a shuffled (not broadcast-only, null-aware) anti join.
    return (T.student.join(T.application.select("student_id"), "student_id", "left_anti")
            .select("student_id", "name"))


def q39_students_with_top_cgpa(T) -> DataFrame:
    s = T.student
    top = s.agg(F.max("cgpa_x100")).scalar()
    return s.where(F.col("cgpa_x100") == top).select("student_id", "name", "cgpa_x100")


# Section 7: eligibility --------------------------------------------------------
def q40_cgpa_check_pair(T, student_id: int = PAIR_STUDENT, job_id: int = PAIR_JOB) -> DataFrame:
    # Both sides are pinned by primary key (the filters reach the scans), so
    # each is one row; Catalyst folds the constant job key and plans a
    # nested-loop join of those two rows, never a product over the tables.
    pair = (T.student.where(F.col("student_id") == student_id)
            .select("student_id", "name", "cgpa_x100", F.lit(job_id).cast("bigint").alias("job_id")))
    j = T.job.where(F.col("job_id") == job_id).select("job_id", "job_title", "min_cgpa_x100")
    return (pair.join(j, "job_id")
            .select(F.col("name").alias("student_name"), "cgpa_x100", "job_title",
                    "min_cgpa_x100",
                    _cgpa_label(F.col("cgpa_x100"), F.col("min_cgpa_x100"))
                    .alias("cgpa_eligibility")))


def q41_students_with_all_skills(T, job_id: int = DIVISION_JOB) -> DataFrame:
    """Relational division for one job (double NOT EXISTS in the reference).

    Required skills of the job are matched against holdings with an equi-join;
    a student qualifies when the match count equals the required count. A job
    that requires nothing admits every student.
    """
    req = T.job_skill.where(F.col("job_id") == job_id).select("skill_id")
    n_req = req.agg(F.count(F.lit(1))).scalar()
    held = (T.student_skill.join(req, "skill_id")
            .groupBy("student_id").agg(F.count(F.lit(1)).alias("n_held")))
    s = T.student.select("student_id", "name")
    return (s.join(held, "student_id", "left")
            .where(F.coalesce("n_held", F.lit(0)) == n_req)
            .select("student_id", "name"))


def q42_cgpa_report_open_jobs(T) -> DataFrame:
    """CGPA eligibility report over every student and every open job.

    The reference lists the full students x open jobs product with a label.
    Here the same report is given per open job as the number of students on
    each side of the label, computed from a CGPA histogram (at most 1001
    values) and a suffix sum; no product of the two tables is formed. Counts
    with skills are in ``eligible_counts``.
    """
    from .eligibility import cgpa_at_least_counts
    n_students = T.student.agg(F.count(F.lit(1))).scalar()
    j = T.job.where(F.col("status") == "Open").select("job_id", "job_title", "min_cgpa_x100")
    return (cgpa_at_least_counts(T, j)
            .select("job_id", "job_title", "min_cgpa_x100",
                    F.col("n_at_least").alias("eligible_students"),
                    (F.lit(n_students) - F.col("n_at_least")).alias("not_eligible_students")))


# Section 8: tracking -----------------------------------------------------------
def q43_application_status(T) -> DataFrame:
    return q17_application_status(T)


def _status_people(T, status: str) -> DataFrame:
    a = T.application.where(F.col("status") == status)
    return _application_people(T, a).select(
        F.col("name").alias("student_name"), "job_title", "status")


def q44_shortlisted(T) -> DataFrame:
    return _status_people(T, "Shortlisted")


def q45_selected(T) -> DataFrame:
    return _status_people(T, "Selected")


def q46_rejected(T) -> DataFrame:
    return _status_people(T, "Rejected")


def q47_offers_received(T) -> DataFrame:
    return q22_offers(T)


def q48_scheduled_interviews(T) -> DataFrame:
    i = (T.interview.where(F.col("interview_status") == "Scheduled")
         .select("application_id", "interview_date", "interview_status"))
    return (_application_people(T).join(i, "application_id")
            .select(F.col("name").alias("student_name"), "job_title", "interview_date",
                    "interview_status"))


def _tracking(T, with_department: bool) -> DataFrame:
    # The small sides meet first; the applications are joined with a person and with a post.
    s = T.student.select("student_id", "name", *(["department_id"] if with_department else []))
    if with_department:
        s = s.join(T.department, "department_id")
    post = (T.job.select("job_id", "job_title", "company_id")
            .join(T.company.select("company_id", "company_name"), "company_id"))
    a = (T.application.select("application_id", "student_id", "job_id", "status")
         .join(s, "student_id").join(post, "job_id"))
    # Interview is 1:M per application: the left join keeps that fan-out.
    i = T.interview.select("application_id", "interview_status")
    o = T.offer.select("application_id", "offer_status")
    return a.join(i, "application_id", "left").join(o, "application_id", "left")


def q49_tracking_report(T) -> DataFrame:
    return _tracking(T, False).select(
        F.col("name").alias("student_name"), "job_title", "company_name",
        F.col("status").alias("application_status"), "interview_status", "offer_status")


# Section 9-10: point lookups (previews of the commented-out changes) ----------
def q50_application_lookup(T, application_id: int = LOOKUP_APPLICATION) -> DataFrame:
    return T.application.where(F.col("application_id") == application_id)


def q51_student_lookup(T, student_id: int = LOOKUP_STUDENT) -> DataFrame:
    return T.student.where(F.col("student_id") == student_id)


def q52_job_lookup(T, job_id: int = LOOKUP_JOB) -> DataFrame:
    return T.job.where(F.col("job_id") == job_id)


def q53_certification_lookup(T, certification_id: int = LOOKUP_CERTIFICATION) -> DataFrame:
    return T.certification.where(F.col("certification_id") == certification_id)


def q54_certifications_after_delete(T, certification_id: int = LOOKUP_CERTIFICATION) -> DataFrame:
    """The commented DELETE, applied as a new snapshot (anti join on the key)."""
    gone = T.certification.where(F.col("certification_id") == certification_id)
    return T.certification.join(gone.select("certification_id"), "certification_id",
                                "left_anti")


# Section 11: dashboard counters ------------------------------------------------
def q55_total_students(T) -> DataFrame:
    return T.student.agg(F.count(F.lit(1)).alias("total_students"))


def q56_total_companies(T) -> DataFrame:
    return T.company.agg(F.count(F.lit(1)).alias("total_companies"))


def q57_total_jobs(T) -> DataFrame:
    return T.job.agg(F.count(F.lit(1)).alias("total_jobs"))


def q58_total_applications(T) -> DataFrame:
    return T.application.agg(F.count(F.lit(1)).alias("total_applications"))


def q59_total_selected_students(T) -> DataFrame:
    # Exact distinct count: distinct student ids first (a shuffle by id with
    # map-side de-duplication), then a count.
    return (T.application.where(F.col("status") == "Selected").select("student_id").distinct()
            .agg(F.count(F.lit(1)).alias("total_selected_students")))


def q60_total_offers(T) -> DataFrame:
    return T.offer.agg(F.count(F.lit(1)).alias("total_offers"))


def q61_open_jobs(T) -> DataFrame:
    return T.job.agg(F.count_if(F.col("status") == "Open").alias("open_jobs"))


def q62_applications_by_status(T) -> DataFrame:
    return q30_applications_by_status(T)


# Section 12: workflow report ----------------------------------------------------
def q63_workflow_report(T) -> DataFrame:
    return _tracking(T, True).select(
        F.col("name").alias("student_name"), F.col("department_name").alias("department"),
        "job_title", F.col("company_name").alias("company"),
        F.col("status").alias("application_status"), "interview_status", "offer_status")


CATALOGUE = {name: fn for name, fn in sorted(globals().items())
             if name.startswith("q") and name[1:3].isdigit() and callable(fn)}
