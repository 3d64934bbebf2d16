"""The reference's write routes as whole-batch snapshot jobs.

Each function takes the bound domain ``T`` (and ``as_of`` where the route
uses today's date) and returns the next snapshot(s) of the tables it
changes; ``sources.snapshot.publish`` writes them as one batch directory,
so frames that must change together (a profile and its login email) are
published together or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import changes as M
from . import intake as V
from .eligibility import DEFAULT_AS_OF, admit_applications
from .ranking import fresh_ids
from ..sources.snapshot import checkpointed, publish

JOB_EDIT_COLUMNS = ["job_title", "job_type", "description", "location", "min_cgpa_x100",
                    "application_deadline", "salary", "status"]
COMPANY_EDIT_COLUMNS = ["company_name", "industry", "location", "website", "email"]
RENUMBER_DEPARTMENTS_BY = 100


def _new_student_accounts(students: DataFrame) -> DataFrame:
    return students.select((F.col("student_id") * 2).alias("user_id"), "email",
                           F.lit("STUDENT").alias("role"), "student_id",
                           F.lit(None).cast("bigint").alias("company_id"))


def register_students(T) -> dict[str, DataFrame]:
    """POST register/student for a batch: V1, then M1 on student, account and
    the selected skills, published together."""
    accepted, _ = V.intake_students(T)
    out = {"student": M.apply_inserts(T.student, accepted, ["student_id"]),
           "user_account": M.apply_inserts(T.user_account, _new_student_accounts(accepted),
                                           ["user_id"])}
    if "skills" in accepted.columns:
        out["student_skill"] = M.apply_inserts(T.student_skill, V.registered_skills(accepted),
                                               ["student_id", "skill_id"])
    return out


def edit_company_profiles(T) -> dict[str, DataFrame]:
    """Profile edits (V2 + M2) with the login email kept in step (M9)."""
    accepted, _ = V.intake_companies(T)
    company = M.apply_updates(T.company, accepted, ["company_id"], COMPANY_EDIT_COLUMNS, ["form_id"])
    acc_changes = accepted.select(F.lit("COMPANY").alias("role"), "company_id", "email", "form_id")
    account = M.apply_updates(T.user_account, acc_changes, ["role", "company_id"], ["email"], ["form_id"])
    return {"company": company, "user_account": account}


def edit_jobs(T) -> dict[str, DataFrame]:
    """Job edits (V3 + M2) and their required-skill sets replaced (M5)."""
    accepted, _ = V.intake_jobs(T)
    last = M.latest_per_key(accepted, ["job_id"], ["form_id"])
    job = M.apply_updates(T.job, last, ["job_id"], JOB_EDIT_COLUMNS)
    sets = last.select("job_id", F.explode("skill_ids").alias("skill_id"))
    return {"job": job, "job_skill": M.replace_set(T.job_skill, sets, ["job_id"], last)}


def change_statuses(T) -> DataFrame:
    """Company status moves on applications (M3, scope + domain checked)."""
    return M.scoped_status_update(T.application, T.job, T.status_change)


def cancel_interviews_of_rejected(T) -> DataFrame:
    """Soft-cancel Scheduled interviews of Rejected applications (M6)."""
    rejected = T.application.where(F.col("status") == "Rejected").select("application_id")
    targets = (T.interview.where(F.col("interview_status") == "Scheduled")
               .join(rejected, "application_id", "left_semi"))
    return M.soft_close(T.interview, targets, ["interview_id"], "interview_status", "Cancelled")


def withdraw_offers_after_status_changes(T) -> DataFrame:
    """Withdraw Pending offers whose application is no longer Selected (M6 after M3)."""
    apps = change_statuses(T)
    gone = apps.where(F.col("status") != "Selected").select("application_id")
    targets = (T.offer.where(F.col("offer_status") == "Pending")
               .join(gone, "application_id", "left_semi"))
    return M.soft_close(T.offer, targets, ["offer_id"], "offer_status", "Withdrawn")


def close_overdue_jobs(T, as_of=DEFAULT_AS_OF) -> DataFrame:
    """Close Open jobs whose deadline passed at ``as_of`` (M6)."""
    targets = T.job.where((F.col("status") == "Open") &
                          (F.col("application_deadline") < F.lit(str(as_of)).cast("date")))
    return M.soft_close(T.job, targets, ["job_id"], "status", "Closed")


def change_student_skills(T) -> DataFrame:
    """Skill adds (M1) and proficiency updates (M2) from V7."""
    accepted, _ = V.intake_student_skills(T)
    keys = ["student_id", "skill_id"]
    updated = M.apply_updates(T.student_skill, accepted.where(F.col("action") == "update"),
                              keys, ["proficiency"])
    return M.apply_inserts(updated, accepted.where(F.col("action") == "insert"), keys)


def certification_delete_requests(T) -> DataFrame:
    """Delete requests (id, caller) for certifications expiring before issue;
    every odd id is asked by another student, so the owner check refuses it."""
    c = T.certification.where(F.col("expiry_date") < F.col("issue_date"))
    return c.select("certification_id",
                    (F.col("student_id") + F.col("certification_id") % 2).alias("student_id"))


def delete_certifications(T) -> DataFrame:
    """DELETE ... WHERE id = ? AND student = ? for a batch (M4)."""
    return M.apply_deletes(T.certification, certification_delete_requests(T),
                           ["certification_id", "student_id"])


def student_delete_requests(students: DataFrame, department_id: int = 3) -> DataFrame:
    return students.where(F.col("department_id") == department_id).select("student_id")


def delete_students(T) -> tuple[dict[str, DataFrame], DataFrame]:
    """After this batch's registrations, delete a department's students:
    RESTRICT children (applications, certifications) block, skills and login
    accounts cascade (M8). New registrations have no children yet, so they go."""
    # A two-step workflow: the registration snapshots feed several joins below,
    # so their lineage is cut once with a reliable checkpoint (shared folder).
    registered = {k: checkpointed(v) for k, v in register_students(T).items()}
    tables = {"student": registered["student"], "user_account": registered["user_account"],
              "student_skill": registered.get("student_skill", T.student_skill),
              "certification": T.certification, "application": T.application}
    return M.cascade_delete(tables, "student", student_delete_requests(registered["student"]))


def upsert_accounts(T) -> DataFrame:
    """INSERT ... ON DUPLICATE KEY UPDATE email (M7): company logins whose
    edit was accepted get the new email, new students get new accounts."""
    companies, _ = V.intake_companies(T)
    students, _ = V.intake_students(T)
    batch = (companies.select((F.col("company_id") * 2 + 1).alias("user_id"), "email",
                              F.lit("COMPANY").alias("role"),
                              F.lit(None).cast("bigint").alias("student_id"), "company_id")
             .unionByName(_new_student_accounts(students)))
    return M.upsert_partial(T.user_account, batch, ["user_id"], "email")


def renumber_departments(T) -> dict[str, DataFrame]:
    """Department ids move by a fixed offset; students follow."""
    key_map = T.department.select(F.col("department_id").alias("old"),
                                  (F.col("department_id") + RENUMBER_DEPARTMENTS_BY).alias("new"))
    return M.cascade_key_update({"department": T.department, "student": T.student},
                                "department", key_map)


def _new_company_accounts(companies: DataFrame) -> DataFrame:
    return companies.select((F.col("company_id") * 2 + 1).alias("user_id"), "email", F.lit("COMPANY").alias("role"),
                            F.lit(None).cast("bigint").alias("student_id"), "company_id")


def _appended(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` have fresh ids, so nothing is looked up."""
    return base.unionByName(rows.select(*base.columns))


def apply_for_jobs(T, as_of=DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """Apply requests (E5) added to the applications under new ids."""
    accepted, _ = admit_applications(T, T.application_request, as_of)
    return {"application": _appended(T.application, accepted)}


def register_companies(T) -> dict[str, DataFrame]:
    """New companies and their logins, published together."""
    accepted, _ = V.intake_company_registrations(T)
    new = checkpointed(fresh_ids(accepted, T.company, "company_id", "form_id"))
    return {"company": _appended(T.company, new),
            "user_account": M.apply_inserts(T.user_account, _new_company_accounts(new), ["user_id"])}


def edit_student_profiles(T) -> dict[str, DataFrame]:
    """Student profile edits (M2) with the login email kept in step (M9, student side)."""
    accepted, _ = V.intake_student_edits(T)
    columns = ["name", "email", "dob", "cgpa_x100", "graduation_year", "department_id"]
    logins = accepted.select(F.lit("STUDENT").alias("role"), "student_id", "email", "form_id")
    return {"student": M.apply_updates(T.student, accepted, ["student_id"], columns, ["form_id"]),
            "user_account": M.apply_updates(T.user_account, logins, ["role", "student_id"], ["email"], ["form_id"])}


def post_jobs(T) -> dict[str, DataFrame]:
    """Accepted job forms (V3) as new postings under new ids, with their required skills."""
    accepted, _ = V.intake_jobs(T)
    new = checkpointed(fresh_ids(accepted.drop("job_id"), T.job, "job_id", "form_id"))
    skills = new.select("job_id", F.explode("skill_ids").alias("skill_id"))
    return {"job": _appended(T.job, new), "job_skill": _appended(T.job_skill, skills)}


def add_certifications(T) -> dict[str, DataFrame]:
    """Accepted certification forms (V4) under new ids, in form order."""
    accepted, _ = V.intake_certifications(T)
    forms = accepted.withColumnRenamed("certification_id", "form_id")
    return {"certification": _appended(T.certification, fresh_ids(forms, T.certification, "certification_id", "form_id"))}


def schedule_interviews(T) -> dict[str, DataFrame]:
    """Accepted interview forms (V5) added under their form's id (M1)."""
    accepted, _ = V.intake_interviews(T)
    return {"interview": M.apply_inserts(T.interview, accepted, ["interview_id"])}


def refused_interviews(T) -> DataFrame:
    """M1's refusals when the interviews of a batch, and those that stand, are sent in once more."""
    accepted, _ = V.intake_interviews(T)
    sent = accepted.unionByName(T.interview).unionByName(accepted)
    return M.split_inserts(T.interview, sent, ["interview_id"])[1].select("interview_id", "application_id", "refused")


def edit_interviews(T) -> dict[str, DataFrame]:
    accepted, _ = V.intake_interview_edits(T)
    columns = ["interview_date", "interview_time", "mode", "interview_status", "remarks"]
    return {"interview": M.apply_updates(T.interview, accepted, ["interview_id"], columns)}


def issue_offers(T, forms: DataFrame | None = None) -> dict[str, DataFrame]:
    """Accepted offer forms (V6) under new ids, in form order."""
    accepted, _ = V.intake_offers(T, forms)
    new = accepted.withColumnRenamed("offer_id", "form_id")
    return {"offer": _appended(T.offer, fresh_ids(new, T.offer, "offer_id", "form_id"))}


def edit_offers(T) -> dict[str, DataFrame]:
    accepted, _ = V.intake_offer_edits(T)
    columns = ["offer_date", "job_title", "salary", "joining_date", "offer_status"]
    return {"offer": M.apply_updates(T.offer, accepted, ["offer_id"], columns)}


def hiring_workflow(T, log) -> int:
    """Three batches, each on the version that the one before published: apply, move statuses, offer.

    The change and offer forms are those of the first version, as they were sent in.
    """
    forms, changes = T.offer_form, T.status_change
    log.run(T, apply_for_jobs)
    log.run(T, lambda now: {"application": M.scoped_status_update(now.application, now.job, changes)})
    return log.run(T, lambda now: issue_offers(now, forms))


ROUTES = {
    "apply_for_jobs": apply_for_jobs,
    "register_companies": register_companies,
    "edit_student_profiles": edit_student_profiles,
    "post_jobs": post_jobs,
    "add_certifications": add_certifications,
    "schedule_interviews": schedule_interviews,
    "edit_interviews": edit_interviews,
    "issue_offers": issue_offers,
    "edit_offers": edit_offers,
    "register_students": register_students,
    "edit_company_profiles": edit_company_profiles,
    "edit_jobs": edit_jobs,
    "change_statuses": lambda T: {"application": change_statuses(T)},
    "cancel_interviews": lambda T: {"interview": cancel_interviews_of_rejected(T)},
    "withdraw_offers": lambda T: {"offer": withdraw_offers_after_status_changes(T)},
    "close_overdue_jobs": lambda T: {"job": close_overdue_jobs(T)},
    "change_student_skills": lambda T: {"student_skill": change_student_skills(T)},
    "delete_certifications": lambda T: {"certification": delete_certifications(T)},
    "delete_students": lambda T: delete_students(T)[0],
    "upsert_accounts": lambda T: {"user_account": upsert_accounts(T)},
    "renumber_departments": renumber_departments,
}


def run_route(T, route: str, out_dir: str, batch_id: str) -> str:
    """Compute one route's snapshots and publish them as one committed batch."""
    return publish(ROUTES[route](T), out_dir, batch_id)
