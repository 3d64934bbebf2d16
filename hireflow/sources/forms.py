"""Form batches derived from the testdata: what the reference's routes receive
one request at a time (register, profile edit, job edit, certification,
interview, offer, skill), here as whole batches of text columns.

Each batch is a pure function of testdata keys, so it grows with the data
and both engines build it identically (``plans/oracle.py`` has the SQL).
Some rows break a rule on purpose (chosen by key arithmetic) so every
quarantine reason occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Line items from this discount on are skills a student holds; the others are skill forms.
SKILL_DISCOUNT = 0.05
NEW_ID_OFFSET = 1_000_000_000  # ids of newly registered students


def skill_id_of(brand):
    return F.regexp_extract(brand, r"([0-9]+)$", 1).cast("bigint")


def _s(c):
    return c.cast("string")


def _date_text(d):
    return F.date_format(d, "yyyy-MM-dd")


def student_form(T) -> DataFrame:
    """Student registrations (V1): one per customer."""
    k = F.col("c_custkey")
    v = (k * 37) % 1100
    email = (F.when(k % 89 == 0, F.lit("no-at-sign.example"))
              .when(k % 50 == 0, F.upper(F.concat(F.lower("c_name"), F.lit("@campus.example"))))
              .when(k % 31 <= 1, F.concat(F.lit("twin"), _s(F.floor(k / 31)), F.lit("@campus.example")))
              .otherwise(F.concat(F.lit(" New."), F.col("c_name"), F.lit("@Campus.Example "))))
    cgpa = (F.when(k % 101 == 0, F.lit("NaN")).when(k % 103 == 0, F.lit("-1.50"))
             .when(k % 47 == 0, F.lit("10.004")).when(k % 61 == 0, F.lit(None).cast("string"))
             .when(k % 43 == 0, F.lit("85e-1"))
             .otherwise(F.concat(_s(F.floor(v / 100)), F.lit("."), F.lpad(_s(v % 100), 2, "0"))))
    return T.raw("customer").select(
        k.alias("form_id"),
        F.when(k % 73 == 0, F.lit("abc")).when(k % 79 == 0, _s(k))
         .otherwise(_s(k + NEW_ID_OFFSET - F.when(k % 83 == 0, 1).otherwise(0))).alias("student_id"),
        F.when(k % 97 == 0, F.lit("   ")).when(k % 67 == 0, F.lit(None).cast("string"))
         .when(k % 71 == 0, F.repeat(F.lit("n"), 121)).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
         .alias("name"),
        email.alias("email"),
        F.when(k % 3 == 0, F.lit("")).when(k % 13 == 0, F.lit("call me"))
         .otherwise(F.concat(F.lit("+91 "), F.lpad(_s(k), 10, "0"))).alias("phone"),
        F.when(k % 17 == 0, F.lit("2001-02-30"))
         .otherwise(F.concat_ws("-", _s(1995 + k % 10), _s(1 + k % 12), _s(1 + k % 28)))
         .alias("dob"),
        cgpa.alias("cgpa"),
        _s(1890 + (k * 7) % 320).alias("graduation_year"),
        F.when(k % 19 == 0, F.lit("99")).otherwise(_s(F.col("c_nationkey"))).alias("department_id"),
        _registration_skills(k).alias("skills"))


def _registration_skills(k):
    """Selected skills of a registration: (skill_id text, proficiency) pairs."""
    level = (F.when(k % 59 == 0, F.lit("Guru")).when(k % 3 == 0, F.lit("Beginner"))
              .when(k % 3 == 1, F.lit("Intermediate")).otherwise(F.lit("Advanced")))
    a = F.struct(_s(k % 25 + 1).alias("skill_id"), level.alias("proficiency"))
    b = F.struct(_s((k * 3) % 25 + 1).alias("skill_id"), F.lit("Beginner").alias("proficiency"))
    bad = F.struct(F.lit("999").alias("skill_id"), F.lit("Beginner").alias("proficiency"))
    return (F.when(k % 4 == 0, F.array().cast("array<struct<skill_id:string,proficiency:string>>"))
             .when(k % 53 == 0, F.array(a, b, bad))
             .otherwise(F.array(a, b)))


def company_form(T) -> DataFrame:
    """Company profile edits (V2): one per supplier, edited by its own account."""
    k = F.col("s_suppkey")
    return T.raw("supplier").select(
        k.alias("form_id"),
        k.alias("company_id"),
        (k * 2 + 1).alias("user_id"),
        F.when(k % 11 == 0, F.concat(F.lit("Supplier#"), F.lpad(_s(k + 1), 9, "0")))
         .otherwise(F.concat(F.lit(" "), F.col("s_name"))).alias("company_name"),
        F.when(k % 7 == 0, F.lit(" ")).otherwise(F.lit("Manufacturing")).alias("industry"),
        F.concat(F.lit("NATION_"), _s(F.col("s_nationkey"))).alias("location"),
        F.when(k % 5 == 0, F.lit("ftp://files.example")).when(k % 5 == 1, F.lit(""))
         .otherwise(F.concat(F.lit("https://s"), _s(k), F.lit(".example"))).alias("website"),
        F.when(k % 9 == 0, F.concat(F.lit("hr"), _s(k + 1), F.lit("@company.example")))
         .when(k % 8 == 0, F.lit("bad email"))
         .otherwise(F.concat(F.lit(" HR"), _s(k), F.lit("@Company.Example "))).alias("email"),
        F.when(k % 4 == 0, F.lit("12"))
         .otherwise(F.concat(F.lit("(080) 555-"), F.lpad(_s(k), 4, "0"))).alias("phone"))


def job_form(T) -> DataFrame:
    """Job edits / postings (V3): one per part, by the job's company."""
    p = T.raw("part")
    owner = T.job.select(F.col("job_id").alias("p_partkey"), "company_id")
    k = F.col("p_partkey")
    a, b = k % 25 + 1, (k * 7) % 25 + 1
    skills = (F.when(k % 37 == 0, F.array(a, b, F.lit(999).cast("bigint")))
               .when(k % 2 == 0, F.array(a, b, a))
               .otherwise(F.array(a, b)))
    return (p.join(owner, "p_partkey").select(
        k.alias("form_id"),
        k.alias("job_id"),
        "company_id",
        _s(F.col("company_id") * 10 + (F.col("p_size") % 7 + 1)).alias("recruiter_id"),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.col("p_name")).alias("job_title"),
        F.col("p_type").alias("job_type"),
        F.concat(F.lit("Updated "), F.col("p_name")).alias("description"),
        F.concat(F.lit("NATION_"), _s(k % 25)).alias("location"),
        F.when(k % 13 == 0, F.lit("11.00")).when(k % 53 == 0, F.lit("-0.004"))
         .otherwise(F.concat(_s(F.floor(F.col("p_size") / 5)), F.lit(".50"))).alias("minimum_cgpa"),
        F.when(k % 17 == 0, F.lit("-5")).when(k % 19 == 0, F.lit("NaN"))
         .otherwise(F.concat(_s(F.floor("p_retailprice")), F.lit(".00"))).alias("salary"),
        F.when(k % 29 == 0, F.lit("2001-13-01"))
         .otherwise(F.concat(F.lit("2001-"), _s(1 + k % 12), F.lit("-15"))).alias("deadline"),
        F.when(k % 31 == 0, F.lit("Paused")).when(k % 43 == 0, F.lit(None).cast("string"))
         .when(F.col("p_size") % 5 == 0, F.lit("Closed")).otherwise(F.lit("Open")).alias("status"),
        skills.alias("skills")))


def certification_form(T) -> DataFrame:
    """Certifications to add (V4): one per order, for the order's customer."""
    o = T.raw("orders")
    k = F.col("o_orderkey")
    issue = F.col("o_orderdate").cast("date")
    return o.select(
        k.alias("form_id"),
        _s(F.col("o_custkey")).alias("student_id"),
        F.when(k % 41 == 0, F.lit(" ")).when(k % 47 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("certification_name"),
        F.concat(F.lit("Board "), F.col("o_orderstatus")).alias("issuing_organization"),
        F.when(k % 43 == 0, F.lit("someday")).otherwise(_date_text(issue)).alias("issue_date"),
        F.when(k % 3 == 0, F.lit("")).when(k % 5 == 0, F.lit("1990-01-01"))
         .otherwise(_date_text(F.date_add(issue, 365))).alias("expiry_date"))


def interview_form(T) -> DataFrame:
    """Interviews to schedule (V5): 'A' line items, by the job's company
    except on line 1, where the caller is the line's supplier."""
    li = T.raw("lineitem").where(F.col("l_returnflag") == "A")
    a = T.application.select("application_id", "job_id")
    j = T.job.select("job_id", F.col("company_id").alias("job_company"))
    n = F.col("l_linenumber")
    key = F.concat_ws("-", *[_s(F.col(c)) for c in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      _s(F.col("l_quantity").cast("int")))
    q = F.col("l_quantity").cast("int")
    return (li.join(a, li.l_orderkey == a.application_id, "left").join(j, "job_id", "left")
            .select(
                key.alias("form_id"),
                _s(F.col("l_orderkey")).alias("application_id"),
                F.when(n == 1, F.col("l_suppkey")).otherwise(F.col("job_company")).alias("company_id"),
                F.when(n == 7, F.lit("tomorrow"))
                 .otherwise(_date_text(F.col("l_shipdate").cast("date"))).alias("interview_date"),
                F.concat(_s(8 + q % 12), F.lit(":"),
                         F.when(n == 6, F.lit("75")).otherwise(F.lit("30"))).alias("interview_time"),
                F.when(n == 5, F.lit("Phone"))
                 .when(F.col("l_linestatus") == "O", F.lit("Online")).otherwise(F.lit("In-person"))
                 .alias("mode"),
                F.when(n == 3, F.lit("Done")).otherwise(F.lit("Scheduled")).alias("interview_status"),
                F.when(n == 4, F.repeat(F.lit("x"), 501)).otherwise(F.lit("")).alias("remarks")))


def offer_form(T) -> DataFrame:
    """Offers to issue (V6): one per application, by the job's company."""
    a = T.application.select("application_id", "job_id", "application_date")
    j = T.job.select("job_id", "company_id")
    k = F.col("application_id")
    d = F.col("application_date")
    return (a.join(j, "job_id").select(
        k.alias("form_id"),
        _s(k).alias("application_id"),
        "company_id",
        _date_text(F.date_add(d, 10)).alias("offer_date"),
        F.when(k % 43 == 0, F.repeat(F.lit("T"), 151))
         .otherwise(F.concat(F.lit("Offer "), _s(k))).alias("job_title"),
        F.when(k % 11 == 0, F.lit("-1")).otherwise(F.lit("50000.00")).alias("salary"),
        F.when(k % 7 == 0, _date_text(F.date_add(d, 5)))
         .otherwise(_date_text(F.date_add(d, 40))).alias("joining_date"),
        F.when(k % 13 == 0, F.lit("Maybe")).otherwise(F.lit("Pending")).alias("offer_status")))


def student_skill_form(T) -> DataFrame:
    """Skill adds / updates (V7): the line items that are not skills held already."""
    li = (T.raw("lineitem").where(F.col("l_discount") < SKILL_DISCOUNT)
          .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    o = T.raw("orders").select("o_orderkey", "o_custkey")
    p = T.raw("part").select("p_partkey", "p_brand")
    n = F.col("l_linenumber")
    key = F.concat_ws("-", *[_s(F.col(c)) for c in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      _s(F.col("l_quantity").cast("int")))
    prof = (F.when(n % 4 == 0, F.lit("Expert")).when(n % 4 == 1, F.lit("Beginner"))
             .when(n % 4 == 2, F.lit("Intermediate")).otherwise(F.lit("Advanced")))
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .select(key.alias("form_id"),
                    F.col("o_custkey").alias("student_id"),
                    _s(F.when(n == 7, F.lit(999).cast("bigint"))
                       .otherwise(skill_id_of(F.col("p_brand")))).alias("skill_id"),
                    prof.alias("proficiency"),
                    (n % 2 == 0).alias("allow_update")))


def company_registration_form(T) -> DataFrame:
    """New companies (registration): one per supplier; some miss a field or use a name or email twice."""
    k = F.col("s_suppkey")
    return T.raw("supplier").select(
        k.alias("form_id"),
        F.when(k % 10 == 0, F.col("s_name")).when(k % 14 <= 1, F.concat(F.lit("Twin Works "), _s(F.floor(k / 14))))
         .otherwise(F.concat(F.lit(" New "), F.col("s_name"), F.lit(" "))).alias("company_name"),
        F.when(k % 12 == 0, F.lit(None).cast("string")).otherwise(F.lit("Services")).alias("industry"),
        F.concat(F.lit("NATION_"), _s(F.col("s_nationkey"))).alias("location"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://n"), _s(k), F.lit(".example"))).alias("website"),
        F.when(k % 13 == 0, F.concat(F.lit("hr"), _s(k), F.lit("@company.example")))
         .when(k % 15 <= 1, F.concat(F.lit("Team"), _s(F.floor(k / 15)), F.lit("@new.example")))
         .otherwise(F.concat(F.lit(" Jobs"), _s(k), F.lit("@New.Example "))).alias("email"))


def interview_edit_form(T) -> DataFrame:
    """Interview edits: one per interview, by the job's company or, now and then, another one."""
    owner = (T.application.select("application_id", "job_id")
             .join(T.job.select("job_id", "company_id"), "job_id").select("application_id", "company_id"))
    k = F.col("application_id")
    return T.interview.join(owner, "application_id").select(
        F.col("interview_id").alias("form_id"), _s(k).alias("application_id"),
        (F.col("company_id") + F.when(k % 6 == 0, 1).otherwise(0)).alias("company_id"),
        F.when(k % 11 == 0, F.lit("someday")).otherwise(_date_text(F.date_add("interview_date", 7))).alias("interview_date"),
        F.when(k % 13 == 0, F.lit("25:00")).otherwise(F.lit("9:30")).alias("interview_time"),
        F.when(k % 17 == 0, F.lit("Phone")).otherwise(F.lit("Online")).alias("mode"),
        F.when(k % 4 == 1, F.lit("Cancelled")).otherwise(F.lit("Completed")).alias("interview_status"),
        F.when(k % 2 == 0, F.lit(" Moved ")).otherwise(F.lit("")).alias("remarks"))


def offer_edit_form(T) -> DataFrame:
    """Offer edits: one per offer, by the job's company or, now and then, another one."""
    owner = (T.application.select("application_id", "job_id")
             .join(T.job.select("job_id", "company_id"), "job_id").select("application_id", "company_id"))
    k = F.col("offer_id")
    return T.offer.join(owner, "application_id").select(
        k.alias("form_id"), _s(F.col("application_id")).alias("application_id"),
        (F.col("company_id") + F.when(k % 6 == 0, 1).otherwise(0)).alias("company_id"),
        _date_text(F.col("offer_date")).alias("offer_date"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Senior "), F.col("job_title"))).alias("job_title"),
        F.when(k % 11 == 0, F.lit("ask")).otherwise(F.lit("61000.50")).alias("salary"),
        _date_text(F.date_add("offer_date", F.when(k % 5 == 0, -1).otherwise(60))).alias("joining_date"),
        F.when(k % 3 == 0, F.lit("Accepted")).otherwise(F.lit("Pending")).alias("offer_status"))
