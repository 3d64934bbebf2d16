"""Testdata -> domain tables.

``Domain(spark, sf_dir)`` exposes the 13 recruiting tables plus the two request
streams as lazily planned DataFrames over the TPC-H-like parquet files. Nothing
is read until an action runs, and Catalyst prunes every unused column and
derivation, so a report that needs ``student`` and ``department`` reads two
columns of ``customer`` and ``nation`` only.

Every derivation is an equi-join, a filter or a grouped aggregate; the only
explicit broadcasts are of ``nation``/``region`` (25 and 5 rows by the TPC-H
definition, independent of scale). All other join strategies are left to AQE,
which measures stage sizes at runtime and falls back to a sort-merge join.

``plans/oracle.py`` holds the same definitions as DuckDB SQL, written
separately, so the oracle check also checks this module.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forms as _forms
from . import schema as S


def skill_id_of(brand: Column) -> Column:
    """Skill id = the number at the end of the brand text."""
    return F.regexp_extract(brand, r"([0-9]+)$", 1).cast("bigint")


class Domain:
    """The bound domain tables of one testdata directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    # raw testdata -------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in S.TABLE_NAMES}

    @cached_property
    def _nation(self) -> DataFrame:
        # 25 rows by definition: safe to broadcast at any scale.
        return F.broadcast(self.raw("nation"))

    # dimensions ---------------------------------------------------------
    @cached_property
    def department(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("department_id"),
            F.col("n_name").alias("department_name"))

    @cached_property
    def student(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("student_id"),
            F.col("c_name").alias("name"),
            F.concat(F.lower("c_name"), F.lit("@campus.example")).alias("email"),
            F.date_add(F.lit("1998-01-01").cast("date"),
                       (F.col("c_custkey") % 2000).cast("int")).alias("dob"),
            F.floor((F.col("c_acctbal") + 1000) / 11.0).cast("int").alias("cgpa_x100"),
            (F.lit(2018) + F.col("c_custkey") % 8).cast("int").alias("graduation_year"),
            F.col("c_nationkey").cast("bigint").alias("department_id"))

    @cached_property
    def company(self) -> DataFrame:
        s = self.raw("supplier")
        n = self._nation
        r = F.broadcast(self.raw("region"))
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                 .join(r, n.n_regionkey == r.r_regionkey)
                 .select(F.col("s_suppkey").alias("company_id"),
                         F.col("s_name").alias("company_name"),
                         F.col("r_name").alias("industry"),
                         F.col("n_name").alias("location"),
                         F.concat(F.lit("https://supplier"), F.col("s_suppkey").cast("string"),
                                  F.lit(".example")).alias("website"),
                         F.concat(F.lit("hr"), F.col("s_suppkey").cast("string"),
                                  F.lit("@company.example")).alias("email")))

    @cached_property
    def skill(self) -> DataFrame:
        return (self.raw("part").select(F.col("p_brand").alias("skill_name")).distinct()
                .select(skill_id_of(F.col("skill_name")).alias("skill_id"), "skill_name"))

    @cached_property
    def recruiter(self) -> DataFrame:
        rid = F.col("l_suppkey") * 10 + F.col("l_linenumber")
        # The company is fixed by the id (line numbers are below 10): grouping
        # by the id alone gives the distinct rows, partitioned by the join key.
        return (self.raw("lineitem")
                .groupBy(rid.alias("recruiter_id"))
                .agg(F.min("l_suppkey").alias("company_id"))
                .withColumn("recruiter_name",
                            F.concat(F.lit("Recruiter "), F.col("recruiter_id").cast("string"))))

    @cached_property
    def job(self) -> DataFrame:
        li = self.raw("lineitem")
        agg = li.groupBy("l_partkey").agg(
            F.min("l_suppkey").alias("company_id"),
            F.max("l_shipdate").cast("date").alias("application_deadline"))
        p = self.raw("part")
        n = self._nation
        return (p.join(agg, agg.l_partkey == p.p_partkey)
                 .join(n, n.n_nationkey == p.p_partkey % 25)
                 .select(
                     F.col("p_partkey").alias("job_id"),
                     F.col("company_id"),
                     (F.col("company_id") * 10 + (F.col("p_size") % 7 + 1)).alias("recruiter_id"),
                     F.col("p_name").alias("job_title"),
                     F.col("p_type").alias("job_type"),
                     F.concat_ws(" ", "p_type", "p_name").alias("description"),
                     F.col("n_name").alias("location"),
                     (F.col("p_size") * 20).alias("min_cgpa_x100"),
                     F.col("application_deadline"),
                     F.col("p_retailprice").alias("salary"),
                     F.when(F.col("p_size") % 5 == 0, "Closed").otherwise("Open").alias("status")))

    @cached_property
    def job_skill(self) -> DataFrame:
        # Job a requires the brands of parts a .. a + (size % 4) - 1: a range
        # join written as an exploded key list and an equi-join.
        p = self.raw("part")
        width = F.col("p_size") % 4
        req = (p.where(width > 0)
                .select(F.col("p_partkey").alias("job_id"),
                        F.explode(F.sequence(F.col("p_partkey"),
                                             F.col("p_partkey") + width - 1)).alias("member")))
        b = p.select(F.col("p_partkey").alias("member"), "p_brand")
        return (req.join(b, "member")
                .select("job_id", skill_id_of(F.col("p_brand")).alias("skill_id"))
                .distinct())

    @cached_property
    def student_skill(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        li = (self.raw("lineitem").where(F.col("l_discount") >= _forms.SKILL_DISCOUNT)
              .select("l_orderkey", "l_partkey", "l_linenumber"))
        p = self.raw("part").select("p_partkey", "p_brand")
        lvl = F.max("l_linenumber")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                  .join(p, li.l_partkey == p.p_partkey)
                  .groupBy("o_custkey", "p_brand")
                  .agg(F.when(lvl <= 2, "Beginner").when(lvl <= 5, "Intermediate")
                        .otherwise("Advanced").alias("proficiency"))
                  .select(F.col("o_custkey").alias("student_id"),
                          skill_id_of(F.col("p_brand")).alias("skill_id"), "proficiency"))

    # facts --------------------------------------------------------------
    @cached_property
    def application(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_custkey") % 7 != 0)
        first_part = (self.raw("lineitem").groupBy("l_orderkey")
                      .agg(F.min("l_partkey").alias("job_id")))
        status = (F.when(F.col("o_orderstatus") == "F", "Selected")
                   .when(F.col("o_orderstatus") == "P", "Applied")
                   .when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "Shortlisted")
                   .otherwise("Rejected"))
        return (o.join(first_part, first_part.l_orderkey == o.o_orderkey)
                 .select(F.col("o_orderkey").alias("application_id"),
                         F.col("o_custkey").alias("student_id"),
                         F.col("job_id"),
                         F.col("o_orderdate").cast("date").alias("application_date"),
                         status.alias("status")))

    @cached_property
    def interview(self) -> DataFrame:
        li = self.raw("lineitem").where(F.col("l_returnflag") == "R")
        key = F.concat_ws("-", *[F.col(c).cast("string") for c in
                                 ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                          F.col("l_quantity").cast("int").cast("string"))
        return li.select(
            key.alias("interview_id"),
            F.col("l_orderkey").alias("application_id"),
            F.col("l_shipdate").cast("date").alias("interview_date"),
            (F.lit(28800) + F.col("l_quantity").cast("int") * 600).alias("interview_time"),
            F.when(F.col("l_linestatus") == "O", "Online").otherwise("In-person").alias("mode"),
            F.when(F.col("l_linenumber") % 3 == 0, "Scheduled")
             .when(F.col("l_linenumber") % 3 == 1, "Completed")
             .otherwise("Cancelled").alias("interview_status"),
            F.when(F.col("l_discount") < 0.05, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Round "), F.col("l_linenumber").cast("string")))
             .alias("remarks"))

    @cached_property
    def offer(self) -> DataFrame:
        a = self.application.where(F.col("status") == "Selected")
        li = (self.raw("lineitem").where(F.col("l_returnflag") == "A")
              .select("l_orderkey", "l_extendedprice"))
        # Grouped by the id alone (the date is fixed by it), so the result is
        # already hash-partitioned by application_id for the joins that use it.
        g = (a.join(li, li.l_orderkey == a.application_id)
              .groupBy("application_id")
              .agg(F.min("application_date").alias("application_date"),
                   F.min("l_extendedprice").alias("salary")))
        return g.select(
            F.col("application_id").alias("offer_id"),
            "application_id",
            F.date_add("application_date", 14).alias("offer_date"),
            F.concat(F.lit("Offer "), F.col("application_id").cast("string")).alias("job_title"),
            "salary",
            F.date_add("application_date", 45).alias("joining_date"),
            F.when(F.col("application_id") % 3 == 0, "Pending")
             .when(F.col("application_id") % 3 == 1, "Accepted")
             .otherwise("Withdrawn").alias("offer_status"))

    @cached_property
    def certification(self) -> DataFrame:
        o = self.raw("orders").where(F.col("o_custkey") % 7 == 0)
        last_ship = (self.raw("lineitem").groupBy("l_orderkey")
                     .agg(F.max("l_shipdate").cast("date").alias("expiry_date")))
        return (o.join(last_ship, last_ship.l_orderkey == o.o_orderkey, "left")
                 .select(F.col("o_orderkey").alias("certification_id"),
                         F.col("o_custkey").alias("student_id"),
                         F.col("o_orderpriority").alias("certification_name"),
                         F.concat(F.lit("Board "), F.col("o_orderstatus")).alias("issuing_organization"),
                         F.col("o_orderdate").cast("date").alias("issue_date"),
                         "expiry_date"))

    @cached_property
    def user_account(self) -> DataFrame:
        null_id = F.lit(None).cast("bigint")
        students = self.raw("customer").select(
            (F.col("c_custkey") * 2).alias("user_id"),
            F.concat(F.lower("c_name"), F.lit("@campus.example")).alias("email"),
            F.lit("STUDENT").alias("role"),
            F.col("c_custkey").alias("student_id"), null_id.alias("company_id"))
        companies = self.raw("supplier").select(
            (F.col("s_suppkey") * 2 + 1).alias("user_id"),
            F.concat(F.lit("hr"), F.col("s_suppkey").cast("string"),
                     F.lit("@company.example")).alias("email"),
            F.lit("COMPANY").alias("role"), null_id.alias("student_id"),
            F.col("s_suppkey").alias("company_id"))
        admin = self.spark.range(1).select(
            F.lit(-1).cast("bigint").alias("user_id"), F.lit("admin@campus.example").alias("email"),
            F.lit("ADMIN").alias("role"), null_id.alias("student_id"), null_id.alias("company_id"))
        return students.unionByName(companies).unionByName(admin)

    # request streams (re-aimed per-request routes) -----------------------
    @cached_property
    def application_request(self) -> DataFrame:
        """Apply requests: every event; user -> student, props k -> job."""
        return (self.raw("events")
                .select(F.col("event_id").alias("request_id"),
                        F.col("user_id").alias("student_id"),
                        F.get_json_object("props", "$.k").cast("bigint").alias("job_id"),
                        F.col("ts")))

    @cached_property
    def status_change(self) -> DataFrame:
        """Status-change requests: 'N' line items of an application's order.

        The caller is the job's company, except on line 1, where it is the
        line's supplier (usually a foreign company, so the scoped update must
        refuse it). Line number picks the status; 5 is outside the domain.
        """
        li = (self.raw("lineitem").where(F.col("l_returnflag") == "N")
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                      "l_shipdate"))
        a = self.application.select("application_id", "job_id")
        j = self.job.select("job_id", F.col("company_id").alias("job_company"))
        status = F.element_at(
            F.array(*[F.lit(s) for s in S.APPLICATION_STATUSES], F.lit("On hold")),
            (F.col("l_linenumber") % 5 + 1).cast("int"))
        return (li.join(a, li.l_orderkey == a.application_id)
                  .join(j, "job_id")
                  .select(
                      F.concat_ws("-", *[F.col(c).cast("string") for c in
                                         ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                                  F.col("l_quantity").cast("int").cast("string")).alias("change_id"),
                      "application_id",
                      F.when(F.col("l_linenumber") == 1, F.col("l_suppkey"))
                       .otherwise(F.col("job_company")).alias("company_id"),
                      status.alias("status"),
                      (F.col("l_shipdate") + F.make_interval(
                          mins=F.col("l_linenumber"))).alias("ts")))

    # form batches (sources/forms.py) ----------------------------------------
    @cached_property
    def student_form(self) -> DataFrame:
        return _forms.student_form(self)

    @cached_property
    def company_form(self) -> DataFrame:
        return _forms.company_form(self)

    @cached_property
    def job_form(self) -> DataFrame:
        return _forms.job_form(self)

    @cached_property
    def certification_form(self) -> DataFrame:
        return _forms.certification_form(self)

    @cached_property
    def interview_form(self) -> DataFrame:
        return _forms.interview_form(self)

    @cached_property
    def offer_form(self) -> DataFrame:
        return _forms.offer_form(self)

    @cached_property
    def student_skill_form(self) -> DataFrame:
        return _forms.student_skill_form(self)

    @cached_property
    def company_registration_form(self) -> DataFrame:
        return _forms.company_registration_form(self)

    @cached_property
    def interview_edit_form(self) -> DataFrame:
        return _forms.interview_edit_form(self)

    @cached_property
    def offer_edit_form(self) -> DataFrame:
        return _forms.offer_edit_form(self)

    # overrides ---------------------------------------------------------------
    def with_tables(self, **frames: DataFrame) -> "Domain":
        """A domain whose named tables are replaced (e.g. by a newer snapshot); the other tables
        stay as they are here, also those whose binding reads a replaced one."""
        d = Domain(self.spark, self.sf_dir)
        d.__dict__.update({t: self.table(t) for t in S.TABLE_NAMES} | frames)
        return d

    # SQL access (S3) -----------------------------------------------------------
    def register_views(self, names=None) -> "Domain":
        """Expose domain tables as temp views so the reference's SQL text runs
        unchanged through ``spark.sql`` (views are lazy plans, not copies)."""
        for name in names or (*S.TABLE_NAMES, "application_request", "status_change"):
            self.table(name).createOrReplaceTempView(name)
        return self

    def read_rows(self, query: str, **params) -> DataFrame:
        """Parameterised read (named ``:markers``), the reference's query helper."""
        self.register_views()
        return self.spark.sql(query, args=params or None)
