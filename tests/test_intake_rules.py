"""Form rules (X1-X11) and batch intake (V1) on explicit batches."""

from __future__ import annotations

import datetime as dt

from hireflow.functions import rules as X
from hireflow.operators import intake as V


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col).first()[0]


def test_email_rule_rejects_trailing_newline_and_spaces(spark):
    assert one(spark, X.is_email("v"), "a@b.co") is True
    assert one(spark, X.is_email("v"), "a@b.co\n") is False
    assert one(spark, X.is_email("v"), "a b@c.de") is False
    assert one(spark, X.is_email(X.normal_email("v")), "  A@B.CO\n") is True


def test_numbers_parse_exactly_or_not_at_all(spark):
    assert float(one(spark, X.parse_decimal("v", 4, 2), "10.00")) == 10.0  # 10.00 fits (4,2)
    assert one(spark, X.parse_decimal("v", 4, 2), "NaN") is None
    assert float(one(spark, X.parse_decimal("v", 4, 2), "1e1")) == 10.0       # numbers with exponents are numbers
    assert float(one(spark, X.parse_decimal("v", 4, 2), " 85E-1 ")) == 8.5
    assert one(spark, X.parse_decimal("v", 4, 2), "1e3") is None and one(spark, X.parse_decimal("v", 4, 2), "1e") is None
    assert one(spark, X.parse_int("v"), "12.0") is None
    assert one(spark, X.parse_int("v"), " 12 ") == 12
    assert one(spark, X.parse_int("v"), "0000000000012") == 12
    assert one(spark, X.parse_long("v"), "9223372036854775807") == 2**63 - 1
    assert one(spark, X.parse_long("v"), "9223372036854775808") is None
    assert one(spark, X.parse_int("v"), None) is None
    assert one(spark, X.strip("v"), "\u00a0 x\u3000") == "x" and one(spark, X.strip("v"), None) == ""


def test_dates_and_times(spark):
    assert one(spark, X.parse_date("v"), "2026-2-3") == dt.date(2026, 2, 3)
    assert one(spark, X.parse_date("v"), "2026-02-30") is None
    assert one(spark, X.parse_time_of_day("v"), "9:05") == 9 * 3600 + 5 * 60
    assert one(spark, X.parse_time_of_day("v"), "24:00") is None


def test_blank_and_optional_fields(spark):
    assert one(spark, X.is_website_or_blank("v"), "") is True
    assert one(spark, X.is_website_or_blank("v"), "ftp://x") is False
    assert one(spark, X.is_phone_or_blank("v"), "(080) 555-1234") is True
    assert one(spark, X.is_phone_or_blank("v"), "12") is False
    assert one(spark, X.blank_to_null("v"), "   ") is None


def test_student_intake_splits_the_whole_batch(seed):
    rows = [
        (1, "1001", "Eve", "eve@uni.example", "", "2004-1-2", "8.50", "2026", "1"),
        (2, "1002", "Fay", " Asha@Uni.Example ", "", "2004-1-2", "8.50", "2026", "1"),
        (3, "1003", "Gia", "a b@c.d", "", "2004-1-2", "10.00", "2026", "1"),
        (4, "1004", "Hal", "hal@uni.example", "", "2026-02-30", "NaN", "2026", "1"),
        (5, "1005", "Ivy", "ivy@uni.example", "", "2004-1-2", "7", "1899", "9"),
        (6, "1006", "  ", "ivy@uni.example", "call me", "2004-1-2", "7", "2026", "2"),
    ]
    batch = seed.spark.createDataFrame(
        rows, "form_id bigint, student_id string, name string, email string, phone string, "
              "dob string, cgpa string, graduation_year string, department_id string")
    accepted, quarantined = V.intake_students(seed, batch)
    acc = {r.student_id: r for r in accepted.collect()}
    assert set(acc) == {1001}
    assert acc[1001].cgpa_x100 == 850 and acc[1001].email == "eve@uni.example"
    q = {r.form_id: r.reasons for r in quarantined.collect()}
    assert q[2] == [V.R_EMAIL_TAKEN]
    assert q[3] == [V.R_EMAIL]
    assert q[4] == [V.R_CGPA, V.R_DOB]
    assert q[5] == [V.R_YEAR, V.R_DEPARTMENT]
    assert q[6] == [V.R_NAME, V.R_PHONE]      # form 5 with the same email is itself invalid
    assert accepted.count() + quarantined.count() == batch.count()


def test_registration_skills_rules_and_rows(seed):
    sk = "array<struct<skill_id:string,proficiency:string>>"
    rows = [
        (1, "2001", "Eve", "eve@uni.example", "", "2004-1-2", "8.50", "2026", "1",
         [("1", "Advanced"), ("2", "Beginner")]),
        (2, "2002", "Fay", "fay@uni.example", "", "2004-1-2", "8.50", "2026", "1",
         [("1", "Guru")]),
        (3, "2003", "Gia", "gia@uni.example", "", "2004-1-2", "8.50", "2026", "1",
         [("9", "Beginner"), ("3", "Beginner"), ("3", "Advanced")]),
        (4, "2004", "Hal", "hal@uni.example", "", "2004-1-2", "8.50", "2026", "1", []),
    ]
    batch = seed.spark.createDataFrame(
        rows, "form_id bigint, student_id string, name string, email string, phone string, "
              f"dob string, cgpa string, graduation_year string, department_id string, skills {sk}")
    accepted, quarantined = V.intake_students(seed, batch)
    q = {r.form_id: r.reasons for r in quarantined.collect()}
    assert q == {2: [V.R_REG_PROFICIENCY], 3: [V.R_REG_SKILL, V.R_REG_SKILL_TWICE]}
    got = sorted(map(tuple, V.registered_skills(accepted).collect()))
    assert got == [(2001, 1, "Advanced"), (2001, 2, "Beginner")]


def test_company_taken_by_another_is_a_keyed_lookup(spark, seed):
    """One email held by many companies (dirty base): a form is refused when
    some *other* company holds it, accepted when only itself does; a company
    still to be made (NULL id) may not take another's email."""
    from hireflow.sources.schema import TABLES
    base = spark.createDataFrame(
        [(i, f"Co{i}", "IT", "Pune", None, "dup@x.example") for i in (1, 2, 3)]
        + [(7, "Solo", "IT", "Pune", None, "solo@x.example")], TABLES["company"].schema)
    T = seed.with_tables(company=base)
    forms = spark.createDataFrame(
        [(1, 1, 101, "Co1", "IT", "Pune", "", "dup@x.example", ""),
         (2, 7, 107, "Solo", "IT", "Pune", "", "solo@x.example", ""),
         (3, None, 108, "New", "IT", "Pune", "", "dup@x.example", "")],
        "form_id long, company_id long, user_id long, company_name string, industry string, "
        "location string, website string, email string, phone string")
    accepted, quarantined = V.intake_companies(T, forms)
    reasons = {r.form_id: r.reasons for r in quarantined.collect()}
    assert V.R_EMAIL_OTHER_COMPANY in reasons[1]
    assert 2 not in reasons and V.R_EMAIL_OTHER_COMPANY in reasons[3]
    assert sorted(r.company_id for r in accepted.collect() if r.company_id is not None) == [7]


def test_invalid_first_form_does_not_block_and_rounding_does_not_admit(seed):
    rows = [
        (1, "3001", "Eve", "eve@uni.example", "", "2004-1-2", "10.004", "2026", "1"),
        (2, "3002", "Eva", "eve@uni.example", "", "2004-1-2", "9", "2026", "1"),
        (3, "3003", "Evi", "eve@uni.example", "", "2004-1-2", "9", "2026", "1"),
        (4, "3002", "Fay", "fay@uni.example", "", "2004-1-2", "9", "2026", "1"),
        (5, "abc", "Gia", "gia@uni.example", "", "2004-1-2", "9", "2026", "1"),
        (6, "3006", None, "hal@uni.example", None, "2004-1-2", "-0.004", "2026", "1"),
        (7, "3007", "x" * 121, "ivy@uni.example", "", "2004-1-2", "9", "2026", "1"),
    ]
    batch = seed.spark.createDataFrame(
        rows, "form_id bigint, student_id string, name string, email string, phone string, "
              "dob string, cgpa string, graduation_year string, department_id string")
    accepted, quarantined = V.intake_students(seed, batch)
    assert [r.form_id for r in accepted.collect()] == [2]
    assert {r.form_id: r.reasons for r in quarantined.collect()} == {
        1: [V.R_CGPA], 3: [V.R_EMAIL_TWICE], 4: [V.R_ID_TWICE], 5: [V.R_ID], 6: [V.R_NAME, V.R_CGPA],
        7: ["name is longer than 120 characters"]}


def test_companies_may_not_take_one_name_in_one_batch(seed):
    forms = seed.spark.createDataFrame(
        [(1, None, None, "New", "IT", "Pune", "", "n@x.example", ""),
         (2, 2, 90002, "New", "IT", "Pune", "", "m@x.example", "")],
        "form_id long, company_id long, user_id long, company_name string, industry string, "
        "location string, website string, email string, phone string")
    accepted, quarantined = V.intake_companies(seed, forms)
    assert accepted.count() == 1
    assert [tuple(r) for r in quarantined.collect()] == [(2, [V.R_COMPANY_NAME_TWICE])]
