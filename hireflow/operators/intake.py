"""Batch intake: a whole batch of form rows in, (accepted, quarantined) out.

Each ``intake_*`` validates every row of a batch with the same rules the
reference applies to one form (V1-V7), plus the database's own guards
(existence, uniqueness, ownership), and returns

* accepted: rows in the domain table's shape, ready for ``changes.apply_*``;
* quarantined: ``form_id`` + ``reasons`` (array, rules in a fixed order).

accepted + quarantined = input, always. A missing field counts as blank. Column
rules are plain expressions; lookups are left joins (flags). Uniqueness inside the
batch holds among the rows that pass all other rules, so an invalid form never
blocks a valid one: forms are admitted in order, as if they came one by one (a grouped
minimum under one key, ``admission.admit_in_order`` under several). Uniqueness against the
base is an equi-join on the key with an ``id <> own`` filter ("taken by someone else").
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as X
from ..sources.snapshot import checkpointed
from .admission import admit_in_order
from ..sources.schema import INTERVIEW_MODES, INTERVIEW_STATUSES, JOB_STATUSES, OFFER_STATUSES, \
    PROFICIENCIES, TABLES

# Reason texts of the engine (the reference shows one generic message per form).
R_ID = "student id is invalid"
R_ID_TAKEN = "student id is already used"
R_ID_TWICE = "student id appears earlier in the batch"
R_COMPANY_EMAIL_TWICE = "email appears earlier in the batch for another company"
R_COMPANY_NAME_TWICE = "company name appears earlier in the batch for another company"
R_NAME = "name is required"
R_EMAIL = "email is invalid"
R_CGPA = "cgpa must be a number from 0 to 10"
R_YEAR = "graduation year must be from 1900 to 2200"
R_PHONE = "phone is invalid"
R_DOB = "date of birth is invalid"
R_DEPARTMENT = "department does not exist"
R_EMAIL_TAKEN = "email is already used"
R_EMAIL_TWICE = "email appears earlier in the batch"
R_REG_SKILL = "unknown skill ids"
R_REG_PROFICIENCY = "proficiency is not allowed"
R_REG_SKILL_TWICE = "a skill is listed twice"
R_COMPANY_NAME = "company name is required"
R_INDUSTRY = "industry is required"
R_LOCATION = "location is required"
R_WEBSITE = "website is invalid"
R_EMAIL_OTHER_ACCOUNT = "email is used by another account"
R_EMAIL_OTHER_COMPANY = "email is used by another company"
R_NAME_OTHER_COMPANY = "company name is used by another company"
R_NAME_TWICE = "company name appears earlier in the batch"
R_TITLE = "job title is required"
R_TYPE = "job type is required"
R_DESCRIPTION = "description is required"
R_MIN_CGPA = "minimum cgpa must be a number from 0 to 10"
R_SALARY = "salary must be a number of at least 0"
R_DEADLINE = "deadline is not a valid date"
R_JOB_STATUS = "status must be Open or Closed"
R_SKILLS = "unknown skill ids"
R_RECRUITER = "recruiter does not belong to the company"
R_CERT_NAME = "certification name is required"
R_ORGANIZATION = "issuing organization is required"
R_ISSUE = "issue date is not a valid date"
R_EXPIRY = "expiry date is not a valid date"
R_EXPIRY_ORDER = "expiry date is before issue date"
R_STUDENT = "student does not exist"
R_INTERVIEW_DATE = "interview date is not a valid date"
R_INTERVIEW_TIME = "interview time is not a valid time"
R_MODE = "mode is not allowed"
R_INTERVIEW_STATUS = "interview status is not allowed"
R_REMARKS = "remarks are longer than 500 characters"
R_NOT_OWNED = "application is not owned by the company"
R_OFFER_DATE = "offer date is not a valid date"
R_JOINING_DATE = "joining date is not a valid date"
R_OFFER_TITLE = "job title is required"
R_OFFER_TITLE_LONG = "job title is longer than 150 characters"
R_OFFER_STATUS = "offer status is not allowed"
R_JOINING_ORDER = "joining date is before offer date"
R_NOT_SELECTED = "application is not Selected"
R_OFFER_EXISTS = "an offer already exists for the application"
R_APP_TWICE = "application appears earlier in the batch"
R_PROFICIENCY = "proficiency is not allowed"
R_SKILL = "skill does not exist"
R_SKILL_HELD = "skill is already held"
R_SKILL_TWICE = "skill appears earlier in the batch"


def _split(df: DataFrame, rules, accepted_cols, once=()) -> tuple[DataFrame, DataFrame]:
    """``once``: (reason, keys, owner) triples. The valid rows are taken in form order; a row is
    refused if an earlier row that got in holds one of its keys, unless ``owner`` names
    a column in which they agree (the same company edits itself twice). Under several keys
    a refused row blocks nobody (``admission``); under one key, the first row is in."""
    # Read by both halves of the result (and by several rounds), so every form is parsed and judged
    # once; a filter on the reasons would otherwise judge the forms again in every use.
    d = checkpointed(df.withColumn("reasons", X.reasons_of(rules)))
    if len(once) > 1:
        (owner,) = {o for _, _, o in once}
        texts = F.array(*[F.lit(text) for text, _, _ in once])
        valid = admit_in_order(d.where(F.size("reasons") == 0), [list(keys) for _, keys, _ in once], owner=owner)
        valid = valid.withColumn("reasons", F.transform("refused_by", lambda k: F.get(texts, k))).drop("refused_by")
        refused = valid.where(F.size("reasons") > 0).select("form_id", "reasons")
        return (valid.where(F.size("reasons") == 0).select(*accepted_cols),
                d.where(F.size("reasons") > 0).select("form_id", "reasons").unionByName(refused))
    for text, keys, owner in once:
        own = F.col(owner) if owner else F.col("form_id")
        first = d.where(F.size("reasons") == 0).groupBy(*keys).agg(
            F.min(F.struct("form_id", own.alias("own"))).alias("_first"))
        late = (F.size("reasons") == 0) & ~own.eqNullSafe(F.col("_first.own"))
        d = (d.join(first, list(keys), "left")
              .withColumn("reasons", F.when(late & F.col("_first").isNotNull(), F.array(F.lit(text)))
                          .otherwise(F.col("reasons"))).drop("_first"))
    accepted = d.where(F.size("reasons") == 0).select(*accepted_cols)
    quarantined = d.where(F.size("reasons") > 0).select("form_id", "reasons")
    return accepted, quarantined


def _flag(keys: DataFrame, on, name: str) -> DataFrame:
    """Distinct keys + a TRUE flag column, for a left join."""
    return keys.select(*on).distinct().withColumn(name, F.lit(True))


def _dealt(batch: DataFrame) -> DataFrame:
    """Forms read from one file of few row groups, dealt out before they are parsed."""
    return batch.repartition(batch.sparkSession.sparkContext.defaultParallelism, "form_id")


def _is(col: str):
    return F.coalesce(F.col(col), F.lit(False))


def _bad_salary():
    """Not a number of at least 0 as written, or one that the table's type cannot hold."""
    return F.col("sal").isNull() | (F.col("sal") < 0) | F.col("sal").try_cast("decimal(12,2)").isNull()


def _owned_by_other(f: DataFrame, base: DataFrame, key: str, owner: str, name: str) -> DataFrame:
    """``f`` + flag ``name``: some base row with ``f``'s key has an owner
    other than ``f``'s own ``owner`` value (F8, "taken by someone else").

    The base is reduced to (key, lowest owner, highest owner) first, so the
    lookup is N:1 however many rows share a key (no pairs within a key): some
    owner differs from the own id exactly when the lowest or the highest
    does. NULL owners never count; a NULL own id (a row still to be made)
    differs from every owner.
    """
    owners = base.groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
    own = F.col(owner)
    other = F.col("_lo").isNotNull() & (own.isNull() | (F.col("_lo") != own) | (F.col("_hi") != own))
    return f.join(owners, key, "left").withColumn(name, other).drop("_lo", "_hi")


def _too_long(table: str, **columns: str) -> list[tuple[str, object]]:
    """One rule per column that the schema bounds: form column -> domain column."""
    bounds = TABLES[table].max_length
    return [(f"{name} is longer than {bounds[name]} characters", X.longer_than(col, bounds[name]))
            for col, name in columns.items() if name in bounds]


def intake_students(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V1: student registrations, with their selected skills (if the batch
    has a ``skills`` list of (skill_id, proficiency)). Accepted rows keep the
    parsed ``skills`` list; ``registered_skills`` turns it into rows."""
    b = _dealt(T.student_form if batch is None else batch)
    has_skills = "skills" in b.columns
    skills = [F.col("skills")] if has_skills else []
    f = b.select("form_id", "student_id", "phone", *skills,
                 X.strip("name").alias("n"), X.normal_email("email").alias("e"),
                 X.parse_number("cgpa").alias("g"), X.parse_long("student_id").alias("id"),
                 X.parse_int("graduation_year").alias("y"), X.parse_date("dob").alias("d"),
                 X.parse_long("department_id").alias("dep"))
    dept = _flag(T.department.select(F.col("department_id").alias("dep")), ["dep"], "dep_ok")
    taken = _flag(T.user_account.select(F.lower("email").alias("e")), ["e"], "taken")
    known = _flag(T.student.select(F.col("student_id").alias("id")), ["id"], "id_known")
    f = f.join(dept, "dep", "left").join(taken, "e", "left").join(known, "id", "left")
    rules = [
        (R_ID, F.col("id").isNull()),
        (R_ID_TAKEN, _is("id_known")),
        (R_NAME, F.col("n") == ""),
        (R_EMAIL, ~X.is_email("e")),
        (R_CGPA, F.col("g").isNull() | (F.col("g") < 0) | (F.col("g") > 10)),
        (R_YEAR, F.col("y").isNull() | (F.col("y") < 1900) | (F.col("y") > 2200)),
        (R_PHONE, ~X.is_phone_or_blank("phone")),
        (R_DOB, F.col("d").isNull()),
        (R_DEPARTMENT, ~_is("dep_ok")),
        (R_EMAIL_TAKEN, _is("taken")),
        *_too_long("student", n="name", e="email"),
    ]
    if has_skills:
        asked = (f.select("form_id", F.explode("skills").alias("s"))
                 .select("form_id", X.parse_long(F.col("s.skill_id")).alias("skill_id")))
        unknown = asked.join(T.skill.select("skill_id"), "skill_id", "left_anti")
        f = f.join(_flag(unknown, ["form_id"], "bad_skill"), "form_id", "left")
        ids = F.transform("skills", lambda x: X.strip(x["skill_id"]))
        rules += [
            (R_REG_SKILL, _is("bad_skill")),
            (R_REG_PROFICIENCY,
             F.exists("skills", lambda x: ~F.coalesce(x["proficiency"], F.lit("Beginner"))
                      .isin(*PROFICIENCIES))),
            (R_REG_SKILL_TWICE, F.size(F.array_distinct(ids)) < F.size("skills")),
        ]
    accepted = ["form_id", F.col("id").alias("student_id"), F.col("n").alias("name"),
                F.col("e").alias("email"), F.col("d").alias("dob"),
                F.round(F.col("g") * 100).cast("int").alias("cgpa_x100"),
                F.col("y").alias("graduation_year"), F.col("dep").alias("department_id"),
                *skills]
    return _split(f, rules, accepted, [(R_EMAIL_TWICE, ["e"], None), (R_ID_TWICE, ["id"], None)])


def registered_skills(accepted: DataFrame) -> DataFrame:
    """student_skill rows of accepted registrations (one per selected skill)."""
    return (accepted.select("student_id", F.explode("skills").alias("s"))
            .select("student_id", X.parse_long(F.col("s.skill_id")).alias("skill_id"),
                    F.coalesce(F.col("s.proficiency"), F.lit("Beginner")).alias("proficiency")))


def intake_companies(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V2: company profile edits (email and name must not belong to others)."""
    b = T.company_form if batch is None else batch
    f = b.select("form_id", "company_id", "user_id", "website", "phone",
                 X.strip("company_name").alias("n"), X.strip("industry").alias("ind"),
                 X.strip("location").alias("loc"), X.normal_email("email").alias("e"))
    acc = T.user_account.select(F.lower("email").alias("e"), "user_id")
    f = _owned_by_other(f, acc, "e", "user_id", "acc_taken")
    f = _owned_by_other(f, T.company.select(F.lower("email").alias("e"), "company_id"),
                        "e", "company_id", "email_taken")
    f = _owned_by_other(f, T.company.select(F.col("company_name").alias("n"), "company_id"),
                        "n", "company_id", "name_taken")
    rules = [
        (R_COMPANY_NAME, F.col("n") == ""),
        (R_INDUSTRY, F.col("ind") == ""),
        (R_LOCATION, F.col("loc") == ""),
        (R_EMAIL, ~X.is_email("e")),
        (R_WEBSITE, ~X.is_website_or_blank("website")),
        (R_PHONE, ~X.is_phone_or_blank("phone")),
        (R_EMAIL_OTHER_ACCOUNT, _is("acc_taken")),
        (R_EMAIL_OTHER_COMPANY, _is("email_taken")),
        (R_NAME_OTHER_COMPANY, _is("name_taken")),
        *_too_long("company", n="company_name", ind="industry", loc="location", e="email",
                   website="website"),
    ]
    accepted = ["form_id", "company_id", F.col("n").alias("company_name"), F.col("ind").alias("industry"),
                F.col("loc").alias("location"), X.blank_to_null("website").alias("website"),
                F.col("e").alias("email")]
    return _split(f, rules, accepted, [(R_COMPANY_EMAIL_TWICE, ["e"], "company_id"),
                                       (R_COMPANY_NAME_TWICE, ["n"], "company_id")])


def intake_student_edits(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Student profile edits (``form_id`` is the student's own id): V1's rules for the profile fields; the
    email must not be another account's."""
    b = _dealt(T.student_form if batch is None else batch)
    f = b.select("form_id", "phone", F.col("form_id").alias("student_id"), X.strip("name").alias("n"),
                 X.normal_email("email").alias("e"), X.parse_number("cgpa").alias("g"),
                 X.parse_int("graduation_year").alias("y"), X.parse_date("dob").alias("d"),
                 X.parse_long("department_id").alias("dep"))
    f = f.withColumn("user_id", F.col("student_id") * 2)
    dept = _flag(T.department.select(F.col("department_id").alias("dep")), ["dep"], "dep_ok")
    known = _flag(T.student.select("student_id"), ["student_id"], "id_known")
    f = f.join(dept, "dep", "left").join(known, "student_id", "left")
    f = _owned_by_other(f, T.user_account.select(F.lower("email").alias("e"), "user_id"), "e", "user_id", "taken")
    rules = [
        (R_STUDENT, ~_is("id_known")),
        (R_NAME, F.col("n") == ""),
        (R_EMAIL, ~X.is_email("e")),
        (R_CGPA, F.col("g").isNull() | (F.col("g") < 0) | (F.col("g") > 10)),
        (R_YEAR, F.col("y").isNull() | (F.col("y") < 1900) | (F.col("y") > 2200)),
        (R_PHONE, ~X.is_phone_or_blank("phone")),
        (R_DOB, F.col("d").isNull()),
        (R_DEPARTMENT, ~_is("dep_ok")),
        (R_EMAIL_OTHER_ACCOUNT, _is("taken")),
        *_too_long("student", n="name", e="email"),
    ]
    accepted = ["form_id", "student_id", F.col("n").alias("name"), F.col("e").alias("email"), F.col("d").alias("dob"),
                F.round(F.col("g") * 100).cast("int").alias("cgpa_x100"), F.col("y").alias("graduation_year"),
                F.col("dep").alias("department_id")]
    return _split(f, rules, accepted, [(R_EMAIL_TWICE, ["e"], "student_id")])


def intake_company_registrations(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New companies: no field of the form may be missing, name and email must be nobody's yet. (A blank
    field is let in here; only profile edits ask for more.)"""
    b = T.company_registration_form if batch is None else batch
    f = b.select("form_id", "website", *[F.col(c).isNull().alias(f"no_{c}") for c in (
                     "company_name", "industry", "location", "email")],
                 X.strip("company_name").alias("n"), X.strip("industry").alias("ind"),
                 X.strip("location").alias("loc"), X.normal_email("email").alias("e"))
    emails = T.user_account.select(F.lower("email").alias("e")).unionByName(T.company.select(F.lower("email").alias("e")))
    f = f.join(_flag(emails, ["e"], "email_taken"), "e", "left")
    f = f.join(_flag(T.company.select(F.col("company_name").alias("n")), ["n"], "name_taken"), "n", "left")
    rules = [
        (R_COMPANY_NAME, F.col("no_company_name")),
        (R_INDUSTRY, F.col("no_industry")),
        (R_LOCATION, F.col("no_location")),
        (R_EMAIL, F.col("no_email")),
        (R_EMAIL_TAKEN, _is("email_taken")),
        (R_NAME_OTHER_COMPANY, _is("name_taken")),
        *_too_long("company", n="company_name", ind="industry", loc="location", e="email", website="website"),
    ]
    accepted = ["form_id", F.col("n").alias("company_name"), F.col("ind").alias("industry"),
                F.col("loc").alias("location"), "website", F.col("e").alias("email")]
    return _split(f, rules, accepted, [(R_EMAIL_TWICE, ["e"], None), (R_NAME_TWICE, ["n"], None)])


def intake_jobs(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V3: job postings/edits; skill ids de-duplicated keeping first (C3),
    all must exist (C4, as an anti join), recruiter must be the company's."""
    b = T.job_form if batch is None else batch
    f = b.select("form_id", "job_id", "company_id", X.text("status").alias("status"),
                 X.parse_long("recruiter_id").alias("recruiter_id"),
                 X.strip("job_title").alias("t"), X.strip("job_type").alias("ty"),
                 X.strip("description").alias("ds"), X.strip("location").alias("loc"),
                 X.parse_number("minimum_cgpa").alias("m"), X.parse_number("salary").alias("sal"),
                 X.parse_date("deadline").alias("dl"),
                 F.array_distinct("skills").alias("skill_ids"))
    asked = f.select("form_id", F.explode("skill_ids").alias("skill_id"))
    unknown = asked.join(T.skill.select("skill_id"), "skill_id", "left_anti")
    rec = _flag(T.recruiter.select("recruiter_id", "company_id"), ["recruiter_id", "company_id"],
                "rec_ok")
    f = (f.join(_flag(unknown, ["form_id"], "bad_skill"), "form_id", "left")
          .join(rec, ["recruiter_id", "company_id"], "left"))
    rules = [
        (R_TITLE, F.col("t") == ""),
        (R_TYPE, F.col("ty") == ""),
        (R_DESCRIPTION, F.col("ds") == ""),
        (R_LOCATION, F.col("loc") == ""),
        (R_MIN_CGPA, F.col("m").isNull() | (F.col("m") < 0) | (F.col("m") > 10)),
        (R_SALARY, _bad_salary()),
        (R_DEADLINE, F.col("dl").isNull()),
        (R_JOB_STATUS, ~F.col("status").isin(*JOB_STATUSES)),
        (R_SKILLS, _is("bad_skill")),
        (R_RECRUITER, ~_is("rec_ok")),
        *_too_long("job", t="job_title", ty="job_type", loc="location"),
    ]
    accepted = ["form_id", "job_id", "company_id", "recruiter_id", F.col("t").alias("job_title"),
                F.col("ty").alias("job_type"), F.col("ds").alias("description"),
                F.col("loc").alias("location"), F.round(F.col("m") * 100).cast("int").alias("min_cgpa_x100"),
                F.col("dl").alias("application_deadline"),
                F.col("sal").try_cast("decimal(12,2)").cast("double").alias("salary"), "status", "skill_ids"]
    return _split(f, rules, accepted)


def intake_certifications(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V4: certifications; expiry optional but not before issue."""
    b = T.certification_form if batch is None else batch
    f = b.select("form_id", "expiry_date",
                 X.parse_long("student_id").alias("sid"),
                 X.strip("certification_name").alias("cn"),
                 X.strip("issuing_organization").alias("org"),
                 X.parse_date("issue_date").alias("iss"),
                 X.parse_date("expiry_date").alias("exp"))
    f = f.join(_flag(T.student.select(F.col("student_id").alias("sid")), ["sid"], "st_ok"),
               "sid", "left")
    blank_expiry = X.strip("expiry_date") == ""
    rules = [
        (R_CERT_NAME, F.col("cn") == ""),
        (R_ORGANIZATION, F.col("org") == ""),
        (R_ISSUE, F.col("iss").isNull()),
        (R_EXPIRY, ~blank_expiry & F.col("exp").isNull()),
        (R_EXPIRY_ORDER, F.col("exp") < F.col("iss")),
        (R_STUDENT, ~_is("st_ok")),
        *_too_long("certification", cn="certification_name", org="issuing_organization"),
    ]
    accepted = [F.col("form_id").alias("certification_id"), F.col("sid").alias("student_id"),
                F.col("cn").alias("certification_name"),
                F.col("org").alias("issuing_organization"),
                F.col("iss").alias("issue_date"), F.col("exp").alias("expiry_date")]
    return _split(f, rules, accepted)


def _owners(T) -> DataFrame:
    return (T.application.select("application_id", "job_id", "status")
            .join(T.job.select("job_id", F.col("company_id").alias("owner_id")), "job_id")
            .select(F.col("application_id").alias("aid"), "owner_id",
                    F.col("status").alias("app_status")))


def intake_interviews(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V5: interviews; the application must belong to the calling company."""
    b = T.interview_form if batch is None else batch
    f = b.select("form_id", "company_id", X.text("mode").alias("mode"),
                 X.text("interview_status").alias("interview_status"), "remarks",
                 X.parse_long("application_id").alias("aid"),
                 X.parse_date("interview_date").alias("dt"),
                 X.parse_time_of_day("interview_time").alias("tm"))
    f = f.join(_owners(T).drop("app_status"), "aid", "left")
    rules = [
        (R_INTERVIEW_DATE, F.col("dt").isNull()),
        (R_INTERVIEW_TIME, F.col("tm").isNull()),
        (R_MODE, ~F.col("mode").isin(*INTERVIEW_MODES)),
        (R_INTERVIEW_STATUS, ~F.col("interview_status").isin(*INTERVIEW_STATUSES)),
        (R_REMARKS, X.longer_than(X.strip("remarks"), 500)),
        (R_NOT_OWNED, ~F.coalesce(F.col("owner_id") == F.col("company_id"), F.lit(False))),
    ]
    accepted = [F.col("form_id").alias("interview_id"), F.col("aid").alias("application_id"),
                F.col("dt").alias("interview_date"), F.col("tm").alias("interview_time"),
                "mode", "interview_status", X.blank_to_null("remarks").alias("remarks")]
    return _split(f, rules, accepted)


def intake_offers(T, batch: DataFrame | None = None, editing: bool = False) -> tuple[DataFrame, DataFrame]:
    """V6: offers; only for owned, Selected applications without an offer. ``editing``: edits
    of offers that exist (``form_id`` is the offer's id), whatever the application's status now."""
    b = T.offer_form if batch is None else batch
    f = b.select("form_id", "company_id", X.text("offer_status").alias("offer_status"),
                 X.parse_long("application_id").alias("aid"),
                 X.parse_date("offer_date").alias("od"), X.parse_date("joining_date").alias("jd"),
                 X.strip("job_title").alias("t"),
                 X.parse_number("salary").alias("sal"))
    has_offer = _flag(T.offer.select(F.col("application_id").alias("aid")), ["aid"], "has_offer")
    f = f.join(_owners(T), "aid", "left").join(has_offer, "aid", "left")
    rules = [
        (R_OFFER_DATE, F.col("od").isNull()),
        (R_JOINING_DATE, F.col("jd").isNull()),
        (R_OFFER_TITLE, F.col("t") == ""),
        (R_OFFER_TITLE_LONG, X.longer_than("t", 150)),
        (R_SALARY, _bad_salary()),
        (R_OFFER_STATUS, ~F.col("offer_status").isin(*OFFER_STATUSES)),
        (R_JOINING_ORDER, F.col("jd") < F.col("od")),
        (R_NOT_OWNED, ~F.coalesce(F.col("owner_id") == F.col("company_id"), F.lit(False))),
    ]
    if not editing:
        rules += [
            (R_NOT_SELECTED, F.col("owner_id").isNotNull() & (F.col("app_status") != "Selected")),
            (R_OFFER_EXISTS, _is("has_offer")),
        ]
    accepted = [F.col("form_id").alias("offer_id"), F.col("aid").alias("application_id"),
                F.col("od").alias("offer_date"), F.col("t").alias("job_title"),
                F.col("sal").try_cast("decimal(12,2)").cast("double").alias("salary"), F.col("jd").alias("joining_date"),
                "offer_status"]
    return _split(f, rules, accepted, [] if editing else [(R_APP_TWICE, ["aid"], None)])


def intake_student_skills(T, batch: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """V7: skill adds/updates; a held skill may only be updated when asked."""
    b = T.student_skill_form if batch is None else batch
    f = b.select("form_id", "student_id", X.text("proficiency").alias("proficiency"), "allow_update",
                 X.parse_long("skill_id").alias("skill_id"))
    known = _flag(T.skill.select("skill_id"), ["skill_id"], "skill_ok")
    held = _flag(T.student_skill.select("student_id", "skill_id"), ["student_id", "skill_id"],
                 "held")
    f = f.join(known, "skill_id", "left").join(held, ["student_id", "skill_id"], "left")
    rules = [
        (R_PROFICIENCY, ~F.col("proficiency").isin(*PROFICIENCIES)),
        (R_SKILL, ~_is("skill_ok")),
        (R_SKILL_HELD, _is("held") & ~_is("allow_update")),
    ]
    accepted = ["student_id", "skill_id", "proficiency",
                F.when(_is("held"), "update").otherwise("insert").alias("action")]
    return _split(f, rules, accepted, [(R_SKILL_TWICE, ["student_id", "skill_id"], None)])


def intake_interview_edits(T) -> tuple[DataFrame, DataFrame]:
    """V5 on edits: ``form_id`` is the interview's id."""
    return intake_interviews(T, T.interview_edit_form)


def intake_offer_edits(T) -> tuple[DataFrame, DataFrame]:
    return intake_offers(T, T.offer_edit_form, editing=True)


INTAKES = {
    "students": intake_students,
    "companies": intake_companies,
    "jobs": intake_jobs,
    "certifications": intake_certifications,
    "interviews": intake_interviews,
    "offers": intake_offers,
    "student_skills": intake_student_skills,
    "student_edits": intake_student_edits,
    "company_registrations": intake_company_registrations,
    "interview_edits": intake_interview_edits,
    "offer_edits": intake_offer_edits,
}
