"""Domain schema: 13 tables, their keys and rules, as data.

The audits (operators/audit.py) and the intake checks (operators/intake.py) are
generated from these specs, so a rule is declared once. Types follow the bound
domain (sources/binding.py): CGPA is an integer in hundredths, money a double
with two decimals, dates are DATE, ids BIGINT, except the interview id, which
is a text key because the bound interview rows carry no numeric key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values of the reference application (value domains enforced by the app).
APPLICATION_STATUSES = ("Applied", "Shortlisted", "Selected", "Rejected")
JOB_STATUSES = ("Open", "Closed")
PROFICIENCIES = ("Beginner", "Intermediate", "Advanced")
INTERVIEW_STATUSES = ("Scheduled", "Completed", "Cancelled")
INTERVIEW_MODES = ("Online", "In-person")
OFFER_STATUSES = ("Pending", "Accepted", "Withdrawn")
ROLES = ("ADMIN", "STUDENT", "COMPANY")
#: The columns that an account of each role is linked by; it has no other link.
ROLE_LINKS = {"ADMIN": (), "STUDENT": ("student_id",), "COMPANY": ("company_id",)}
LINK_COLUMNS = ("student_id", "company_id")

CGPA_MAX_X100 = 1000  # CGPA 0.00 .. 10.00 in hundredths


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "RESTRICT"  # or CASCADE


@dataclass(frozen=True)
class Check:
    name: str
    predicate: str  # SQL boolean expression; NULL counts as passing, as in SQL CHECK


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[Check, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def not_null(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.schema.fields if not f.nullable)


def _s(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


L, S, I, D, DB = T.LongType(), T.StringType(), T.IntegerType(), T.DateType(), T.DoubleType()

TABLES: dict[str, TableSpec] = {
    "department": TableSpec(
        "department",
        _s(("department_id", L, False), ("department_name", S, False)),
        ("department_id",), unique=(("department_name",),),
        max_length={"department_name": 100}),
    "company": TableSpec(
        "company",
        _s(("company_id", L, False), ("company_name", S, False), ("industry", S, False),
           ("location", S, False), ("website", S, True), ("email", S, True)),
        ("company_id",), unique=(("company_name",),),
        max_length={"company_name": 150, "industry": 100, "location": 150,
                    "website": 255, "email": 150}),
    "skill": TableSpec(
        "skill", _s(("skill_id", L, False), ("skill_name", S, False)),
        ("skill_id",), unique=(("skill_name",),), max_length={"skill_name": 100}),
    "student": TableSpec(
        "student",
        _s(("student_id", L, False), ("name", S, False), ("email", S, False),
           ("dob", D, False), ("cgpa_x100", I, False), ("graduation_year", I, False),
           ("department_id", L, False)),
        ("student_id",), unique=(("email",),),
        foreign_keys=(ForeignKey(("department_id",), "department", ("department_id",)),),
        checks=(Check("cgpa_range", f"cgpa_x100 BETWEEN 0 AND {CGPA_MAX_X100}"),),
        max_length={"name": 120, "email": 150}),
    "recruiter": TableSpec(
        "recruiter",
        _s(("recruiter_id", L, False), ("company_id", L, False), ("recruiter_name", S, False)),
        ("recruiter_id",),
        foreign_keys=(ForeignKey(("company_id",), "company", ("company_id",)),),
        max_length={"recruiter_name": 120}),
    "job": TableSpec(
        "job",
        _s(("job_id", L, False), ("company_id", L, False), ("recruiter_id", L, False),
           ("job_title", S, False), ("job_type", S, False), ("description", S, False),
           ("location", S, False), ("min_cgpa_x100", I, False),
           ("application_deadline", D, False), ("salary", DB, False), ("status", S, False)),
        ("job_id",),
        foreign_keys=(ForeignKey(("company_id",), "company", ("company_id",)),
                      ForeignKey(("recruiter_id",), "recruiter", ("recruiter_id",))),
        checks=(Check("min_cgpa_range", f"min_cgpa_x100 BETWEEN 0 AND {CGPA_MAX_X100}"),
                Check("salary_non_negative", "salary >= 0")),
        max_length={"job_title": 150, "job_type": 50, "location": 150, "status": 30},
        domains={"status": JOB_STATUSES}),
    "student_skill": TableSpec(
        "student_skill",
        _s(("student_id", L, False), ("skill_id", L, False), ("proficiency", S, False)),
        ("student_id", "skill_id"),
        foreign_keys=(ForeignKey(("student_id",), "student", ("student_id",), "CASCADE"),
                      ForeignKey(("skill_id",), "skill", ("skill_id",))),
        max_length={"proficiency": 30}, domains={"proficiency": PROFICIENCIES}),
    "certification": TableSpec(
        "certification",
        _s(("certification_id", L, False), ("student_id", L, False),
           ("certification_name", S, False), ("issuing_organization", S, False),
           ("issue_date", D, False), ("expiry_date", D, True)),
        ("certification_id",),
        foreign_keys=(ForeignKey(("student_id",), "student", ("student_id",)),),
        checks=(Check("expiry_after_issue", "expiry_date >= issue_date"),),
        max_length={"certification_name": 150, "issuing_organization": 150}),
    "job_skill": TableSpec(
        "job_skill", _s(("job_id", L, False), ("skill_id", L, False)),
        ("job_id", "skill_id"),
        foreign_keys=(ForeignKey(("job_id",), "job", ("job_id",), "CASCADE"),
                      ForeignKey(("skill_id",), "skill", ("skill_id",)))),
    "application": TableSpec(
        "application",
        _s(("application_id", L, False), ("student_id", L, False), ("job_id", L, False),
           ("application_date", D, False), ("status", S, False)),
        ("application_id",), unique=(("student_id", "job_id"),),
        foreign_keys=(ForeignKey(("student_id",), "student", ("student_id",)),
                      ForeignKey(("job_id",), "job", ("job_id",))),
        max_length={"status": 30}, domains={"status": APPLICATION_STATUSES}),
    "interview": TableSpec(
        "interview",
        _s(("interview_id", S, False), ("application_id", L, False),
           ("interview_date", D, False), ("interview_time", I, False), ("mode", S, False),
           ("interview_status", S, False), ("remarks", S, True)),
        ("interview_id",),
        foreign_keys=(ForeignKey(("application_id",), "application", ("application_id",)),),
        checks=(Check("time_of_day", "interview_time BETWEEN 0 AND 86399"),),
        max_length={"mode": 30, "interview_status": 30, "remarks": 500},
        domains={"mode": INTERVIEW_MODES, "interview_status": INTERVIEW_STATUSES}),
    "offer": TableSpec(
        "offer",
        _s(("offer_id", L, False), ("application_id", L, False), ("offer_date", D, False),
           ("job_title", S, False), ("salary", DB, False), ("joining_date", D, False),
           ("offer_status", S, False)),
        ("offer_id",), unique=(("application_id",),),
        foreign_keys=(ForeignKey(("application_id",), "application", ("application_id",)),),
        checks=(Check("salary_non_negative", "salary >= 0"),
                Check("joining_after_offer", "joining_date >= offer_date")),
        max_length={"job_title": 150, "offer_status": 30},
        domains={"offer_status": OFFER_STATUSES}),
    "user_account": TableSpec(
        "user_account",
        _s(("user_id", L, False), ("email", S, False), ("role", S, False),
           ("student_id", L, True), ("company_id", L, True)),
        ("user_id",), unique=(("email",), ("student_id",), ("company_id",)),
        foreign_keys=(ForeignKey(("student_id",), "student", ("student_id",), "CASCADE"),
                      ForeignKey(("company_id",), "company", ("company_id",), "CASCADE")),
        max_length={"email": 150}, domains={"role": ROLES}),
}

TABLE_NAMES = tuple(TABLES)


def children_of(parent: str) -> list[tuple[str, ForeignKey]]:
    """(child table, fk) pairs that reference ``parent``."""
    return [(spec.name, fk) for spec in TABLES.values() for fk in spec.foreign_keys
            if fk.parent == parent]
