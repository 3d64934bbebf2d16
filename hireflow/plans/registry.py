"""Registry of named queries: Spark builders and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` binds the testdata directory to
the domain and runs one operator over whole tables. ``ORACLE[name]`` is the
matching DuckDB SQL (with the domain CTEs), absent where the operator has no
plain-SQL twin (streaming); those are checked by row count and by the tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..operators import audit as K
from ..operators import catalogue as C
from ..operators import changesets as CS
from ..operators import eligibility as E
from ..operators import eligible_counts as EC
from ..operators import intake as V
from ..operators import lists as LS
from ..operators import reports as R
from ..operators import search as SE
from ..operators import sketches as SK
from ..session import shared_path
from ..sources import snapshot as SN
from ..sources import versions as VN
from ..sources.binding import Domain
from ..streaming import jobs as ST
from ..sources.schema import TABLE_NAMES
from . import sql_audit, sql_catalogue, sql_changes, sql_domain, sql_intake, sql_reports
from .oracle import FORMS, with_binding

Builder = Callable[[Domain], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def register(name: str, builder: Builder, sql: str | None = None) -> None:
    _BUILDERS[name] = builder
    if sql is not None:
        _SQL[name] = sql


def flat_lists(df: DataFrame) -> DataFrame:
    """Registered outputs stay flat: list columns become sorted text."""
    for name, dtype in df.dtypes:
        if dtype.startswith("array<struct"):
            df = df.withColumn(name, F.array_join(F.sort_array(F.transform(
                name, lambda x: F.concat_ws(":", x["skill_id"], x["proficiency"]))), ","))
        elif dtype.startswith("array"):
            df = df.withColumn(name, F.array_join(F.col(name).cast("array<string>"), ","))
    return df


_FLAT_SQL = {
    "student_form": """SELECT * REPLACE (array_to_string(list_sort(list_transform(skills,
                          lambda x: x.skill_id || ':' || x.proficiency)), ',') AS skills)
                       FROM student_form""",
    "job_form": "SELECT * REPLACE (array_to_string(skills, ',') AS skills) FROM job_form",
}

# S1 scan_full / S6 schema contract: every bound table, all columns.
for _t in (*TABLE_NAMES, "application_request", "status_change", *FORMS):
    register(f"scan_{_t}", lambda T, _t=_t: flat_lists(T.table(_t)),
             _FLAT_SQL.get(_t, f"SELECT * FROM {_t}"))

for _name, _fn in C.CATALOGUE.items():
    register(_name, _fn, sql_catalogue.SQL.get(_name))

register("eligibility_requests", E.eligibility_requests, sql_domain.SQL["eligibility_requests"])
for _name in ("skill_holders_per_job", "eligible_students_per_job", "eligible_jobs_per_student",
              "student_cgpa_ranks", "cgpa_rank_intervals"):
    register(_name, getattr(EC, _name), sql_domain.SQL[_name])
register("eligible_counts", E.eligible_counts, sql_domain.SQL["eligible_counts"])
register("admit_accepted", lambda T: E.admit_applications(T, T.application_request)[0],
         sql_domain.SQL["admit_accepted"])
register("admit_rejected",
         lambda T: E.admit_applications(T, T.application_request)[1]
         .selectExpr("request_id", "student_id", "job_id",
                     "array_join(reasons, ' | ') AS reasons_text"),
         sql_domain.SQL["admit_rejected"])


_REPORTS = {
    "lookup_departments": R.lookup_departments,
    "lookup_skills": R.lookup_skills,
    "lookup_recruiters": R.lookup_recruiters,
    "eligibility_options_jobs": R.eligibility_options_jobs,
    "students_directory": R.students_directory,
    "jobs_board": lambda T: R.jobs_board(T).withColumn(
        "required_skills", F.array_join("required_skills", ", ")),
    "company_directory": R.company_directory,
    "admin_stats": R.admin_stats,
    "home_stats": R.home_stats,
    "company_stats": R.company_stats,
    "company_dashboard": R.company_dashboard,
    "status_summary_by_company": lambda T: R.status_summary(T, True),
    "status_summary_all": lambda T: R.status_summary(T, False),
    "recent_jobs": R.recent_jobs,
    "recent_applications": R.recent_applications,
    "latest_interview": R.latest_interview,
    "latest_interview_window": R.latest_interview_window,
    "applicant_board": R.applicant_board,
    "offer_per_application": R.offer_per_application,
    "job_skills_text": R.job_skills_text,
    "job_profile": R.job_profile,
    "student_profile": R.student_profile,
    "student_applications": R.student_applications,
    "stage_timeline": R.stage_timeline,
    "application_detail": R.application_detail,
    "scoped_applications": R.scoped_applications,
    "interview_owners": R.interview_owners,
    "offer_owners": R.offer_owners,
    "status_change_ownership": R.status_change_ownership,
    "search_applications": R.search_applications,
    "search_students": R.search_students,
    "search_jobs": R.search_jobs,
    "search_companies": R.search_companies,
    "job_type_facets": R.job_type_facets,
    "status_map_entries": R.status_map_entries,
    "job_cards": R.job_cards,
    "application_lookup_sql": R.application_lookup_sql,
    "application_interviews": LS.application_interviews,
    "company_jobs": LS.company_jobs,
    "student_certifications": LS.student_certifications,
    "search_jobs_many": SE.search_jobs_many,
    "search_students_many": SE.search_students_many,
}
for _name, _fn in _REPORTS.items():
    register(_name, _fn, sql_reports.SQL.get(_name))

register("audit_table_rules", K.audit_table_rules, sql_audit.SQL["audit_table_rules"])
for _name, _fn in K.AUDITS.items():
    register(_name, _fn, sql_audit.SQL[_name])


def _accepted(name: str) -> Builder:
    def run(T):
        acc = V.INTAKES[name](T)[0]
        if "skill_ids" in acc.columns:  # list order is input order; compare as sorted text
            acc = (acc.withColumn("skills_text", F.array_join(
                F.sort_array("skill_ids").cast("array<string>"), ",")).drop("skill_ids"))
        if "skills" in acc.columns:
            acc = flat_lists(acc).withColumnRenamed("skills", "skills_text")
        return acc
    return run


def _quarantined(name: str) -> Builder:
    def run(T):
        q = V.INTAKES[name](T)[1]
        return q.select("form_id", F.array_join("reasons", " | ").alias("reasons_text"))
    return run


for _name in V.INTAKES:
    register(f"intake_{_name}_accepted", _accepted(_name),
             sql_intake.SQL[f"intake_{_name}_accepted"])
    register(f"intake_{_name}_quarantined", _quarantined(_name),
             sql_intake.SQL[f"intake_{_name}_quarantined"])

_CHANGES = {
    "snapshot_application_after_apply": lambda T: CS.apply_for_jobs(T)["application"],
    "snapshot_company_after_company_registration": lambda T: CS.register_companies(T)["company"],
    "snapshot_user_account_after_company_registration": lambda T: CS.register_companies(T)["user_account"],
    "snapshot_student_after_profile_edit": lambda T: CS.edit_student_profiles(T)["student"],
    "snapshot_user_account_after_profile_edit": lambda T: CS.edit_student_profiles(T)["user_account"],
    "snapshot_job_after_posting": lambda T: CS.post_jobs(T)["job"],
    "snapshot_job_skill_after_posting": lambda T: CS.post_jobs(T)["job_skill"],
    "snapshot_certification_after_adds": lambda T: CS.add_certifications(T)["certification"],
    "snapshot_interview_after_scheduling": lambda T: CS.schedule_interviews(T)["interview"],
    "refused_interview_inserts": CS.refused_interviews,
    "snapshot_interview_after_edit": lambda T: CS.edit_interviews(T)["interview"],
    "snapshot_offer_after_issue": lambda T: CS.issue_offers(T)["offer"],
    "snapshot_offer_after_edit": lambda T: CS.edit_offers(T)["offer"],
    "versioned_offer_after_workflow": lambda T: _versioned_offers(T),
    "snapshot_student_after_registration": lambda T: CS.register_students(T)["student"],
    "snapshot_student_skill_after_registration":
        lambda T: CS.register_students(T)["student_skill"],
    "snapshot_user_account_after_registration": lambda T: CS.register_students(T)["user_account"],
    "snapshot_company_after_edit": lambda T: CS.edit_company_profiles(T)["company"],
    "snapshot_user_account_after_company_edit":
        lambda T: CS.edit_company_profiles(T)["user_account"],
    "snapshot_job_after_edit": lambda T: CS.edit_jobs(T)["job"],
    "snapshot_job_skill_after_edit": lambda T: CS.edit_jobs(T)["job_skill"],
    "snapshot_application_after_status_changes": CS.change_statuses,
    "snapshot_interview_after_cancellations": CS.cancel_interviews_of_rejected,
    "snapshot_offer_after_withdrawals": CS.withdraw_offers_after_status_changes,
    "snapshot_job_after_closures": CS.close_overdue_jobs,
    "snapshot_student_skill_after_changes": CS.change_student_skills,
    "snapshot_certification_after_deletes": CS.delete_certifications,
    "cascade_students_blocked": lambda T: CS.delete_students(T)[1],
    "snapshot_student_after_cascade": lambda T: CS.delete_students(T)[0]["student"],
    "snapshot_student_skill_after_cascade": lambda T: CS.delete_students(T)[0]["student_skill"],
    "snapshot_user_account_after_cascade": lambda T: CS.delete_students(T)[0]["user_account"],
    "snapshot_user_account_after_upsert": CS.upsert_accounts,
    "snapshot_department_after_renumber": lambda T: CS.renumber_departments(T)["department"],
    "snapshot_student_after_renumber": lambda T: CS.renumber_departments(T)["student"],
}
for _name, _fn in _CHANGES.items():
    register(_name, _fn, sql_changes.SQL[_name])


def _stream_dir(T, name: str) -> str:
    return shared_path(T.spark, "streams", f"{name}-{uuid.uuid4().hex}")


def _stream_admission(T, which: int) -> DataFrame:
    """Run the admission stream over the staged request files, to the end."""
    base = _stream_dir(T, "admission")
    src = ST.stage(T.application_request, f"{base}/source")
    ST.stream_admission(T.spark, src, T, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    out = ST.admitted(T.spark, f"{base}/out")[which]
    if which == 1:
        out = out.selectExpr("request_id", "student_id", "job_id",
                             "array_join(reasons, ' | ') AS reasons_text")
    return out


def _stream_status(T) -> DataFrame:
    base = _stream_dir(T, "status")
    src = ST.stage(T.status_change, f"{base}/source")
    ST.stream_status_latest(T.spark, src, T, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return ST.latest_status_snapshot(T.spark, f"{base}/out")


SKILL_FORM_SCHEMA = T_.StructType([
    T_.StructField("form_id", T_.StringType()), T_.StructField("student_id", T_.LongType()),
    T_.StructField("skill_id", T_.StringType()), T_.StructField("proficiency", T_.StringType()),
    T_.StructField("allow_update", T_.BooleanType())])


def _versioned_offers(T) -> DataFrame:
    """Apply, status moves and offers as three batches on a version log; the offers of the last version."""
    log = VN.VersionLog(T.spark, _stream_dir(T, "versions"))
    return log.read("offer", CS.hiring_workflow(T, log))


def _load_batch(T) -> DataFrame:
    """The skill form as a CSV batch file, read back typed and PERMISSIVE."""
    path = _stream_dir(T, "batch") + "/student_skill_form.csv"
    T.student_skill_form.write.option("header", True).csv(path)
    good, _bad = SN.read_batch(T.spark, path, SKILL_FORM_SCHEMA)
    return good


#: A skill form as a line of a file; of the students whose id ends in 3 the id is not a number.
_FORM_LINES = {
    "csv": "concat(form_id, ',', sid, ',', skill_id, ',', proficiency, ',', allow_update)",
    "json": """concat('{"form_id": "', form_id, '", "student_id": ', if(sid rlike '^[0-9]+$', sid, concat('"', sid, '"')),
               ', "skill_id": "', skill_id, '", "proficiency": "', proficiency, '", "allow_update": ', allow_update, '}')""",
}
_FORM_TEXTS = """SELECT coalesce(CAST(form_id AS {text}), '') AS form_id,
    CASE WHEN student_id % 10 = 3 THEN 'S' ELSE '' END || coalesce(CAST(student_id AS {text}), '') AS sid,
    coalesce(CAST(skill_id AS {text}), '') AS skill_id, coalesce(proficiency, '') AS proficiency,
    CASE WHEN allow_update THEN 'true' ELSE 'false' END AS allow_update
    FROM {table}"""


def _batch_files(T) -> tuple[DataFrame, DataFrame]:
    """The skill forms as two batches of CSV and JSON lines, read back."""
    base = _stream_dir(T, "batches")
    texts = T.spark.sql(_FORM_TEXTS.format(text="string", table="{forms}"), forms=T.student_skill_form)
    paths = {}
    for fmt, line in _FORM_LINES.items():
        paths[fmt] = f"{base}/{fmt}"
        texts.select(F.expr(line).alias("value")).write.text(paths[fmt])
    return SN.read_batches(T.spark, paths, SKILL_FORM_SCHEMA)


def _published(T) -> DataFrame:
    """Sink: registration batch published, then read back from the committed batch."""
    target = CS.run_route(T, "register_students", _stream_dir(T, "published"), "registration")
    return SN.read_published(T.spark, target, "student")


register("load_batch_student_skill_form", _load_batch, "SELECT * FROM student_skill_form")
register("company_applicants_sketched", SK.company_applicants,
         """SELECT company_id, count(DISTINCT student_id) AS applicants, TRUE AS within_bound
            FROM application JOIN job USING (job_id) WHERE company_id IS NOT NULL GROUP BY company_id""")
register("load_batches_malformed", lambda T: _batch_files(T)[1].groupBy("source_format").agg(
    F.count("*").alias("bad_lines"), F.countDistinct("raw").alias("texts")),
    f"""WITH forms AS ({_FORM_TEXTS.format(text="VARCHAR", table="student_skill_form")}),
        bad AS (SELECT concat_ws(',', form_id, sid, skill_id, proficiency, allow_update) AS line
                FROM forms WHERE sid LIKE 'S%')
    SELECT f.source_format, count(*) AS bad_lines, count(DISTINCT line) AS texts
    FROM bad, (VALUES ('csv'), ('json')) f(source_format) GROUP BY f.source_format""")
register("load_batches_well_formed", lambda T: _batch_files(T)[0].drop("source_file"),
         """SELECT s.form_id, student_id, CAST(skill_id AS VARCHAR) AS skill_id, proficiency, allow_update, f.source_format
            FROM student_skill_form s, (VALUES ('csv'), ('json')) f(source_format)
            WHERE student_id % 10 <> 3""")
register("published_student_after_registration", _published,
         sql_changes.SQL["snapshot_student_after_registration"])
register("stream_admission_accepted", lambda T: _stream_admission(T, 0),
         sql_domain.SQL["admit_accepted"])
register("stream_admission_rejected", lambda T: _stream_admission(T, 1),
         sql_domain.SQL["admit_rejected"])
register("stream_status_latest", _stream_status,
         sql_changes.SQL["snapshot_application_after_status_changes"])


def _bind(builder: Builder) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return builder(Domain(spark, sf_dir))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(b) for name, b in _BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_binding(sql) for name, sql in _SQL.items()}
