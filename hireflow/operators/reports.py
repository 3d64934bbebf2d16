"""Reports: directories, dashboards, feeds, timelines, scoped views, search.

Per-request pages of the reference become jobs over all companies / students
/ applications at once. Shapes that matter at scale:

* counts per parent are pre-aggregated on the child table (map-side combine)
  and left-joined to the parent, never counted over a joined fan-out;
* "latest / the one per key" uses a grouped ``max(struct)``: a hash aggregate
  with partial aggregation, so a key holding a third of the rows is combined
  before the shuffle (a window would sort that whole key in one task);
* nested lists are only built where the list is bounded by a catalogue
  (skills of a job or a student); unbounded children (applications of a
  student) are given as flat, sortable rows plus counts;
* visibility is an equi-join on scope keys (kind, id), salted where one key
  (the admin scope) matches every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schema import APPLICATION_STATUSES

# Fixed values of the reference application (page labels).
STAGE_REACHED = "Status reached"
STAGE_NOT_REACHED = "Not reached"
STAGE_PENDING = "Pending"
NO_INTERVIEW = "No interview scheduled"
INTERVIEW_RECORD = "interview record"
NO_OFFER = "No offer generated"



def _count(df: DataFrame, key: str, name: str, where=None) -> DataFrame:
    if where is not None:
        df = df.where(where)
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _zero(col: str):
    return F.coalesce(F.col(col), F.lit(0).cast("bigint")).alias(col)


# Ordered lookup lists ------------------------------------------------------
def lookup_departments(T) -> DataFrame:
    return T.department.orderBy("department_name", "department_id")


def lookup_skills(T) -> DataFrame:
    return T.skill.orderBy("skill_name", "skill_id")


def lookup_recruiters(T) -> DataFrame:
    return (T.recruiter.select("company_id", "recruiter_id", "recruiter_name")
            .orderBy("company_id", "recruiter_name", "recruiter_id"))


def eligibility_options_jobs(T) -> DataFrame:
    return (T.job.join(T.company.select("company_id", "company_name"), "company_id")
            .select("job_id", "job_title", "company_name")
            .orderBy("job_title", "job_id"))


def students_directory(T) -> DataFrame:
    return (T.student.join(T.department, "department_id")
            .select("student_id", "name", "email", "cgpa_x100", "graduation_year",
                    "department_name")
            .orderBy("name", "student_id"))


def jobs_board(T) -> DataFrame:
    """Job list with company name and required skills, by (status, deadline)."""
    return (T.job.join(T.company.select("company_id", "company_name"), "company_id")
            .join(skills_by_job(T), "job_id", "left")
            .select("job_id", "job_title", "job_type", "location", "min_cgpa_x100",
                    "application_deadline", "salary", "status", "company_name",
                    F.coalesce("required_skills", F.array().cast("array<string>"))
                    .alias("required_skills"))
            .orderBy("status", "application_deadline", "job_id"))


# Counters and directories ---------------------------------------------
def company_directory(T) -> DataFrame:
    """Companies with distinct recruiter and opportunity counts.

    The reference counts DISTINCT over a recruiter x job fan-out; counting
    each child per company first gives the same numbers without the fan-out.
    """
    r = (T.recruiter.select("company_id", "recruiter_id").distinct()
         .groupBy("company_id").agg(F.count(F.lit(1)).alias("recruiter_count")))
    j = (T.job.select("company_id", "job_id").distinct()
         .groupBy("company_id").agg(F.count(F.lit(1)).alias("opportunity_count")))
    return (T.company.join(r, "company_id", "left").join(j, "company_id", "left")
            .select("company_id", "company_name", "industry", "location", "website", "email",
                    _zero("recruiter_count"), _zero("opportunity_count"))
            .orderBy("company_name", "company_id"))


def _total(df: DataFrame, name: str, where=None):
    if where is not None:
        df = df.where(where)
    return df.agg(F.count(F.lit(1))).scalar().alias(name)


def admin_stats(T) -> DataFrame:
    """Ten counters in one row (A10): one aggregate per table, as scalars."""
    a, j = T.application, T.job
    return (T.student.agg(F.count(F.lit(1)).alias("students"))
            .select("students",
                    _total(T.company, "companies"),
                    j.agg(F.count(F.lit(1))).scalar().alias("opportunities"),
                    j.agg(F.count_if(F.col("status") == "Open")).scalar()
                    .alias("open_opportunities"),
                    a.agg(F.count(F.lit(1))).scalar().alias("applications"),
                    a.agg(F.count_if(F.col("status") == "Shortlisted")).scalar()
                    .alias("shortlisted"),
                    a.agg(F.count_if(F.col("status") == "Selected")).scalar().alias("selected"),
                    a.agg(F.count_if(F.col("status") == "Rejected")).scalar().alias("rejected"),
                    _total(T.interview, "interviews"),
                    _total(T.offer, "offers")))


def home_stats(T) -> DataFrame:
    """Six counters of the home page."""
    return (T.student.agg(F.count(F.lit(1)).alias("students"))
            .select("students", _total(T.company, "companies"),
                    T.job.agg(F.count_if(F.col("status") == "Open")).scalar().alias("open_jobs"),
                    _total(T.application, "applications"),
                    _total(T.interview, "interviews"), _total(T.offer, "offers")))


def company_stats(T) -> DataFrame:
    """Per company: recruiters, opportunities, applicants, open opportunities."""
    r = _count(T.recruiter, "company_id", "recruiters")
    j = (T.job.groupBy("company_id")
         .agg(F.count(F.lit(1)).alias("opportunities"),
              F.count_if(F.col("status") == "Open").alias("open_opportunities")))
    per_job = _count(T.application, "job_id", "n")
    apps = (T.job.select("job_id", "company_id").join(per_job, "job_id")
            .groupBy("company_id").agg(F.sum("n").alias("applicants")))
    return (T.company.select("company_id", "company_name")
            .join(r, "company_id", "left").join(j, "company_id", "left")
            .join(apps, "company_id", "left")
            .select("company_id", "company_name", _zero("recruiters"), _zero("opportunities"),
                    _zero("applicants"), _zero("open_opportunities")))


def company_dashboard(T) -> DataFrame:
    """Company profile + counters (E11, company side)."""
    return (T.company.join(company_stats(T).drop("company_name"), "company_id")
            .select("company_id", "company_name", "industry", "location", "website", "email",
                    "recruiters", "opportunities", "applicants", "open_opportunities"))


def status_summary(T, by_company: bool = True) -> DataFrame:
    """Applications per status (all four shown, 0 if absent) plus total.

    Counted by (job, status) first, with map-side combine, so a popular job is a few
    rows when it meets the job table; the total counts every row, whatever its status.
    """
    per_job = T.application.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))
    a = per_job.join(T.job.select("job_id", "company_id"), "job_id")
    keys = ["company_id"] if by_company else []
    counted = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return a.groupBy(*keys).agg(
        *[counted(F.col("status") == s).alias(s.lower()) for s in APPLICATION_STATUSES],
        counted(F.lit(True)).alias("total"))


def status_map(T) -> DataFrame:
    """Per company the status -> total map of the applications page."""
    s = status_summary(T, True)
    entries = [F.struct(F.lit(st).alias("key"), F.col(st.lower()).alias("value"))
               for st in APPLICATION_STATUSES]
    return s.select("company_id", F.map_from_entries(F.array(*entries)).alias("summary"), "total")


# Top-k, latest per key ---------------------------------------------------
def recent_jobs(T, k: int = 5) -> DataFrame:
    """Newest k jobs by id (O3) — a limit that is the feature."""
    return (T.job.join(T.company.select("company_id", "company_name"), "company_id")
            .select("job_id", "job_title", "job_type", "location", "min_cgpa_x100",
                    "application_deadline", "status", "company_name")
            .orderBy(F.desc("job_id")).limit(k))


def recent_applications(T, k: int = 5) -> DataFrame:
    """Newest k applications by date; ties broken by id (O3)."""
    return (T.application.join(T.student.select("student_id", "name"), "student_id")
            .join(T.job.select("job_id", "job_title"), "job_id")
            .select("application_id", F.col("name").alias("student_name"), "job_title",
                    "application_date", "status")
            .orderBy(F.desc("application_date"), F.desc("application_id")).limit(k))


_INTERVIEW_ORDER = ("interview_date", "interview_time", "interview_id")
_INTERVIEW_REST = ("mode", "interview_status")


def latest_interview(T) -> DataFrame:
    """Latest interview per application by (date, time, id) desc."""
    latest = (T.interview.groupBy("application_id")
              .agg(F.max(F.struct(*_INTERVIEW_ORDER, *_INTERVIEW_REST)).alias("i")))
    return latest.select("application_id", *[F.col(f"i.{c}").alias(c)
                                             for c in (*_INTERVIEW_ORDER, *_INTERVIEW_REST)])


def latest_interview_window(T) -> DataFrame:
    """Same as ``latest_interview`` as row_number() = 1 (the SQL window form)."""
    w = Window.partitionBy("application_id").orderBy(*[F.desc(c) for c in _INTERVIEW_ORDER])
    return (T.interview.withColumn("rn", F.row_number().over(w)).where("rn = 1")
            .select("application_id", *_INTERVIEW_ORDER, *_INTERVIEW_REST))


def applicant_board(T) -> DataFrame:
    """Every company's applicants with latest interview and offer (E7, O4+O5).

    One aggregate for the latest interview and one join for the (unique)
    offer replace the reference's eleven correlated subqueries per row.
    The offer is shown for Selected applications only, as on the page.
    """
    a = (T.application.join(T.student.select("student_id", "name", "email"), "student_id")
         .join(T.job.select("job_id", "job_title", "company_id"), "job_id"))
    i = latest_interview(T).select(
        "application_id", "interview_id", "interview_date", "interview_time",
        F.col("mode").alias("interview_mode"), "interview_status")
    o = T.offer.select("application_id", "offer_id", "offer_date",
                       F.col("job_title").alias("offer_job_title"),
                       F.col("salary").alias("offer_salary"),
                       F.col("joining_date").alias("offer_joining_date"), "offer_status")
    board = a.join(i, "application_id", "left").join(o, "application_id", "left")
    selected = F.col("status") == "Selected"
    offer_cols = ["offer_id", "offer_date", "offer_job_title", "offer_salary",
                  "offer_joining_date", "offer_status"]
    return board.select(
        "company_id", "application_id", "name", "email", "job_title", "application_date",
        "status", "interview_id", "interview_date", "interview_time", "interview_mode",
        "interview_status",
        *[F.when(selected, F.col(c)).alias(c) for c in offer_cols])


def offer_per_application(T) -> DataFrame:
    """Applications with their single offer or NULLs."""
    return (T.application.select("application_id", "status")
            .join(T.offer.drop("job_title"), "application_id", "left"))


# Lists bounded by the skill catalogue ------------------------------
def skills_by_job(T) -> DataFrame:
    """job_id -> required skill names sorted (C1). Jobs without skills: no row."""
    return (T.job_skill.join(T.skill, "skill_id").groupBy("job_id")
            .agg(F.sort_array(F.collect_list("skill_name")).alias("required_skills")))


def job_skills_text(T) -> DataFrame:
    """Every job with its skills as text ('' when none) and their number."""
    s = skills_by_job(T)
    skills = F.coalesce("required_skills", F.array().cast("array<string>"))
    return (T.job.select("job_id", "job_title").join(s, "job_id", "left")
            .select("job_id", "job_title", F.array_join(skills, ", ").alias("skills_text"),
                    F.size(skills).cast("bigint").alias("n_skills")))


def job_profile(T) -> DataFrame:
    """Job + company + recruiter + skill list (C8); recruiter is an inner join."""
    c = T.company.select("company_id", "company_name",
                         F.col("industry").alias("company_industry"),
                         F.col("location").alias("company_location"),
                         F.col("website").alias("company_website"),
                         F.col("email").alias("company_email"))
    r = T.recruiter.select("recruiter_id", "recruiter_name")
    skills = F.coalesce("required_skills", F.array().cast("array<string>"))
    return (T.job.join(c, "company_id").join(r, "recruiter_id")
            .join(skills_by_job(T), "job_id", "left")
            .select("job_id", "job_title", "job_type", "description", "location", "min_cgpa_x100",
                    "application_deadline", "salary", "status", "company_name",
                    "company_industry", "company_location", "company_website", "company_email",
                    "recruiter_name", F.array_join(skills, ", ").alias("skills_text")))


def student_profile(T) -> DataFrame:
    """Student + department + skills (sorted, with proficiency) + child counts
    and the latest application / certification (C7, E11 student side).

    Applications and certifications are not nested (unbounded per student);
    see ``student_applications`` for the list itself.
    """
    sk = (T.student_skill.join(T.skill, "skill_id").groupBy("student_id")
          .agg(F.sort_array(F.collect_list(F.struct("skill_name", "proficiency")))
               .alias("skills")))
    apps = (T.application.groupBy("student_id")
            .agg(F.count(F.lit(1)).alias("n_applications"),
                 F.max(F.struct("application_date", "application_id")).alias("last_app")))
    certs = (T.certification.groupBy("student_id")
             .agg(F.count(F.lit(1)).alias("n_certifications"),
                  F.max("issue_date").alias("latest_certification_date")))
    skills = F.coalesce("skills", F.array())
    return (T.student.join(T.department, "department_id")
            .join(sk, "student_id", "left").join(apps, "student_id", "left")
            .join(certs, "student_id", "left")
            .select("student_id", "name", "email", "cgpa_x100", "graduation_year",
                    "department_name",
                    F.array_join(F.transform(skills, lambda x: F.concat_ws(
                        ":", x["skill_name"], x["proficiency"])), ", ").alias("skills_text"),
                    F.size(skills).cast("bigint").alias("n_skills"),
                    _zero("n_applications"),
                    F.col("last_app.application_id").alias("latest_application_id"),
                    _zero("n_certifications"), "latest_certification_date"))


def student_applications(T) -> DataFrame:
    """Each student's applications with job and company, newest first."""
    return (T.application.join(T.job.select("job_id", "job_title", "company_id"), "job_id")
            .join(T.company.select("company_id", "company_name"), "company_id")
            .select("student_id", "application_id", "job_title", "company_name",
                    "application_date", "status")
            .orderBy("student_id", F.desc("application_date"), F.desc("application_id")))


# Application detail and timeline -----------------------------------------
def stage_timeline(T) -> DataFrame:
    """Per application the five timeline stages of the detail page."""
    n_i = _count(T.interview, "application_id", "interview_count")
    o = T.offer.select("application_id", "offer_status")
    a = (T.application.join(n_i, "application_id", "left")
         .join(o, "application_id", "left"))
    n = F.coalesce(F.col("interview_count"), F.lit(0).cast("bigint"))
    status = F.col("status")
    return a.select(
        "application_id", "application_date", "status",
        F.when(status.isin("Shortlisted", "Selected"), STAGE_REACHED)
         .when(status == "Rejected", STAGE_NOT_REACHED)
         .otherwise(STAGE_PENDING).alias("shortlist_stage"),
        status.isin("Shortlisted", "Selected", "Rejected").alias("shortlist_complete"),
        n.alias("interview_count"),
        F.when(n == 0, NO_INTERVIEW)
         .otherwise(F.concat(n.cast("string"), F.lit(" " + INTERVIEW_RECORD),
                             F.when(n != 1, "s").otherwise(""))).alias("interview_label"),
        status.isin("Selected", "Rejected").alias("outcome_complete"),
        F.coalesce(F.col("offer_status"), F.lit(NO_OFFER)).alias("offer_label"))


def application_detail(T) -> DataFrame:
    """Six-table application detail (J4, E10) with interview count and offer; the interviews
    themselves are ``lists.application_interviews``. Job, company and recruiter meet first, so the
    applications are joined with three tables' worth of names once."""
    s = T.student.select("student_id", F.col("name").alias("student_name"),
                         F.col("email").alias("student_email"), "cgpa_x100", "department_id")
    j = T.job.select("job_id", "job_title", "job_type", "location", "company_id", "recruiter_id")
    n_i = _count(T.interview, "application_id", "interview_count")
    s = s.join(T.department, "department_id")
    j = (j.join(T.company.select("company_id", "company_name"), "company_id")
         .join(T.recruiter.select("recruiter_id", "recruiter_name"), "recruiter_id"))
    offer = T.offer.select("application_id", "offer_id", "offer_status", "offer_date", "joining_date",
                           F.col("job_title").alias("offer_title"), F.col("salary").alias("offer_salary"))
    return (T.application.join(s, "student_id").join(j, "job_id")
            .join(n_i, "application_id", "left").join(offer, "application_id", "left")
            .select("application_id", "application_date", "status", "student_id", "company_id",
                    "student_name", "student_email", "cgpa_x100", "department_name",
                    "job_title", "job_type", "location", "company_name", "recruiter_name",
                    _zero("interview_count"), "offer_id", "offer_status", "offer_date", "joining_date",
                    "offer_title", "offer_salary"))


# Visibility and ownership ----------------------------------------------
def scoped_applications(T) -> DataFrame:
    """(scope, user_id, application_id): who may see each application.

    Students see their own and companies their jobs'. Admins see all: that is one row
    per application with scope ADMIN and no user, not a copy per admin.
    """
    a = (T.application.select("application_id", "student_id", "job_id")
         .join(T.student.select("student_id"), "student_id", "left_semi")
         .join(T.job.select("job_id", "company_id"), "job_id")
         .join(T.company.select("company_id"), "company_id", "left_semi"))
    acc = T.user_account
    students = acc.where(acc.role == "STUDENT").select("user_id", "student_id")
    companies = acc.where(acc.role == "COMPANY").select("user_id", "company_id")
    rows = lambda d, scope: d.select(F.lit(scope).alias("scope"), "user_id", "application_id")
    every = a.select(F.lit(None).cast("bigint").alias("user_id"), "application_id")
    return (rows(a.join(students, "student_id"), "STUDENT")
            .unionByName(rows(a.join(companies, "company_id"), "COMPANY"))
            .unionByName(rows(every, "ADMIN")))


def interview_owners(T) -> DataFrame:
    """interview -> application -> job -> owning company."""
    return (T.interview.select("interview_id", "application_id")
            .join(T.application.select("application_id", "job_id"), "application_id")
            .join(T.job.select("job_id", "company_id"), "job_id")
            .select("interview_id", "application_id", "company_id"))


def offer_owners(T) -> DataFrame:
    return (T.offer.select("offer_id", "application_id")
            .join(T.application.select("application_id", "job_id"), "application_id")
            .join(T.job.select("job_id", "company_id"), "job_id")
            .select("offer_id", "application_id", "company_id"))


def status_change_ownership(T) -> DataFrame:
    """Does the calling company own the application it changes?."""
    owner = (T.application.select("application_id", "job_id")
             .join(T.job.select("job_id", F.col("company_id").alias("owner_id")), "job_id"))
    c = T.status_change.select("change_id", "application_id", "company_id")
    return (c.join(owner, "application_id", "left")
            .select("change_id", "application_id", "company_id",
                    F.coalesce(F.col("owner_id") == F.col("company_id"), F.lit(False))
                    .alias("owned")))


# Search boxes -----------------------------------------------------------
def _contains(cols, term: str):
    return F.lower(F.concat_ws(" ", *cols)).contains(term.lower())


def search_applications(T, term: str = "bolt") -> DataFrame:
    """Applications list rows whose visible text contains ``term``."""
    rows = (T.application.join(T.student.select("student_id", "name"), "student_id")
            .join(T.job.select("job_id", "job_title", "company_id"), "job_id")
            .join(T.company.select("company_id", "company_name"), "company_id")
            .select("application_id", F.col("name").alias("student_name"), "job_title",
                    "company_name", "application_date", "status"))
    visible = [F.col(c).cast("string") for c in rows.columns]
    return rows.where(_contains(visible, term))


def search_students(T, term: str = "nation_1") -> DataFrame:
    rows = students_directory(T)
    visible = [F.col("student_id").cast("string"), "name", "department_name",
               F.format_number(F.col("cgpa_x100") / 100, 2),
               F.col("graduation_year").cast("string"), "email"]
    return rows.where(_contains(visible, term))


def search_jobs(T, term: str = "ring", status: str = "Open", job_type: str = "") -> DataFrame:
    """Title/company contains ``term`` AND optional status AND optional type."""
    rows = T.job.join(T.company.select("company_id", "company_name"), "company_id")
    cond = _contains([F.col("job_title"), F.col("company_name")], term)
    if status:
        cond = cond & (F.lower("status") == status.lower())
    if job_type:
        cond = cond & (F.lower("job_type") == job_type.lower())
    return rows.where(cond).select("job_id", "job_title", "company_name", "status", "job_type")


def search_companies(T, term: str = "america") -> DataFrame:
    """Name / industry / location contains ``term``."""
    return (company_directory(T)
            .where(_contains([F.col("company_name"), F.col("industry"), F.col("location")], term)))


def job_type_facets(T) -> DataFrame:
    """Distinct job types for the filter box, sorted."""
    return T.job.select("job_type").distinct().orderBy("job_type")


def status_map_entries(T) -> DataFrame:
    """``status_map`` flattened: one (company, status, total) per domain status."""
    m = status_map(T)
    return m.select("company_id", F.explode("summary").alias("status", "n"))


# Display formatting of the job cards ------------------------------------------
def job_cards(T) -> DataFrame:
    """Card fields of the jobs page: company initial, status class, two-decimal
    CGPA and salary text."""
    return (T.job.join(T.company.select("company_id", "company_name"), "company_id")
            .select("job_id",
                    F.substring("company_name", 1, 1).alias("company_initial"),
                    F.lower("status").alias("status_class"),
                    F.format_string("%.2f", F.col("min_cgpa_x100") / 100).alias("cgpa_text"),
                    F.format_string("%.2f", F.col("salary")).alias("salary_text")))


def application_lookup_sql(T, application_id: int = 2) -> DataFrame:
    """A point lookup through the SQL API with a named parameter."""
    return T.read_rows("SELECT * FROM application WHERE application_id = :id",
                       id=application_id)
