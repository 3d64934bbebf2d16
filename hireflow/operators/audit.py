"""Integrity audits: the DDL's constraints and the app's rules, as violation rows.

Every audit returns ``(rule, table_name, key, detail)`` so the audits union
into one report. They are generated from ``sources/schema.TABLES``; each one
is a filter, a grouped count with map-side combine, or an anti join — all
shuffle by the constraint's own key, none collects a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import LINK_COLUMNS, ROLE_LINKS, TABLES, TableSpec
from ..sources.snapshot import checkpointed
from .eligibility import DEFAULT_AS_OF, eligibility_pairs

AUDIT_COLUMNS = ("rule", "table_name", "key", "detail")


def key_text(cols) -> Column:
    """A key's text form: values joined by '|' (NULL shown as empty)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def _rows(df: DataFrame, rule: str, table: str | Column, key: Column, detail: Column) -> DataFrame:
    table_col = table if isinstance(table, Column) else F.lit(table)
    return df.select(F.lit(rule).alias("rule"), table_col.alias("table_name"),
                     key.alias("key"), detail.alias("detail"))


def _union(frames: list[DataFrame], spark) -> DataFrame:
    if not frames:
        return spark.createDataFrame([], "rule string, table_name string, key string, detail string")
    return reduce(DataFrame.unionByName, frames)


#: Shuffled bytes (compressed) that one task of an audit reads, about; keys take up to a hundred times as much in memory.
TASK_BYTES = 4 * 1024 * 1024
TASK_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _in_small_tasks(report: DataFrame) -> DataFrame:
    """``report`` made with tasks of at most about ``TASK_BYTES``.

    Adaptive execution puts the partitions of a union's branches together into as few tasks as the cores
    need, so a task's sorts and hash tables would grow with the tables.
    """
    spark = report.sparkSession
    before = spark.conf.get(TASK_SIZE, None)
    spark.conf.set(TASK_SIZE, str(TASK_BYTES))
    try:
        return checkpointed(report)
    finally:
        if before is None:
            spark.conf.unset(TASK_SIZE)
        else:
            spark.conf.set(TASK_SIZE, before)


def _duplicates(df: DataFrame, cols, rule: str, table: str) -> DataFrame:
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    g = df.where(present).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _rows(g, rule, table, key_text(cols),
                 F.concat(F.lit("rows="), F.col("n").cast("string")))


def audit_pk(T) -> DataFrame:
    """K1: primary keys unique and non-null (composite keys included)."""
    out = []
    for spec in TABLES.values():
        df = T.table(spec.name)
        out.append(_duplicates(df, spec.primary_key, "pk_duplicate", spec.name))
        null_pk = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.primary_key])
        out.append(_rows(df.where(null_pk), "pk_null", spec.name,
                         key_text(spec.primary_key), F.lit("")))
    return _in_small_tasks(_union(out, T.spark))


def audit_unique(T) -> DataFrame:
    """K2: UNIQUE constraints; rows with a NULL in the key are exempt, as in SQL."""
    out = [_duplicates(T.table(spec.name), cols, "unique_duplicate", spec.name)
           for spec in TABLES.values() for cols in spec.unique]
    return _in_small_tasks(_union(out, T.spark))


def audit_fk(T) -> DataFrame:
    """K3: child rows whose (non-null) foreign key has no parent row.

    All children of one parent meet it in one anti join, so every table is read once. A value that
    carries most rows of a child (one of 25 skills) does no harm: a small parent is sent to the rows
    once its size is known, and a large one's skewed partitions are split on the children's side.
    """
    by_parent: dict[tuple[str, tuple[str, ...]], list[DataFrame]] = {}
    for spec in TABLES.values():
        for fk in spec.foreign_keys:
            present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in fk.columns])
            refs = T.table(spec.name).where(present).select(
                *[F.col(c).alias(p) for c, p in zip(fk.columns, fk.parent_columns)],
                F.lit(spec.name).alias("table_name"),
                key_text(spec.primary_key).alias("key"),
                F.concat(F.lit(fk.parent + ":"), key_text(fk.columns)).alias("detail"))
            by_parent.setdefault((fk.parent, tuple(fk.parent_columns)), []).append(refs)
    out = []
    for (parent, cols), refs in by_parent.items():
        rows = reduce(DataFrame.unionByName, refs)
        orphans = rows.join(T.table(parent).select(*cols), list(cols), "left_anti")
        out.append(_rows(orphans, "fk_missing", F.col("table_name"), F.col("key"), F.col("detail")))
    return _in_small_tasks(_union(out, T.spark))


def audit_check(T) -> DataFrame:
    """K4: CHECK rules; a NULL outcome passes, as in SQL."""
    out = []
    for spec in TABLES.values():
        for chk in spec.checks:
            bad = T.table(spec.name).where(~F.coalesce(F.expr(chk.predicate), F.lit(True)))
            out.append(_rows(bad, "check_failed", spec.name, key_text(spec.primary_key),
                             F.lit(chk.name)))
    return _union(out, T.spark)


def _profile_checks(spec: TableSpec) -> list[tuple[str, str, Column]]:
    checks = [(c, "not_null", F.col(c).isNull()) for c in spec.not_null]
    checks += [(c, f"max_length_{n}", F.length(c) > n) for c, n in spec.max_length.items()]
    return checks


def audit_not_null(T) -> DataFrame:
    """K5: NOT NULL and VARCHAR(n) profile — one scan per table, all columns.

    Returns one row per (table, column, rule) with the number of violations.
    """
    out = []
    for spec in TABLES.values():
        checks = _profile_checks(spec)
        counts = T.table(spec.name).agg(
            *[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(checks)])
        rows = F.explode(F.array(*[
            F.struct(F.lit(col).alias("column_name"), F.lit(rule).alias("rule"),
                     F.col(f"c{i}").alias("violations"))
            for i, (col, rule, _) in enumerate(checks)]))
        out.append(counts.select(F.lit(spec.name).alias("table_name"), rows.alias("r"))
                   .select("table_name", "r.column_name", "r.rule", "r.violations"))
    return reduce(DataFrame.unionByName, out)


def audit_domain(T) -> DataFrame:
    """K6: values outside the app's fixed value sets."""
    out = []
    for spec in TABLES.values():
        for col, values in spec.domains.items():
            bad = T.table(spec.name).where(F.col(col).isNotNull() & ~F.col(col).isin(*values))
            out.append(_rows(bad, "domain", spec.name, key_text(spec.primary_key),
                             F.concat(F.lit(col + "="), F.col(col))))
    return _union(out, T.spark)


def wrong_links() -> Column:
    """An account is linked otherwise than its role expects (an unknown role expects nothing that fits)."""
    linked = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in LINK_COLUMNS])
    expected = F.create_map(*[F.lit(x) for role, links in ROLE_LINKS.items() for x in (role, ",".join(links))])
    return ~linked.eqNullSafe(F.try_element_at(expected, F.col("role")))


def audit_role_link(T) -> DataFrame:
    """K7: admin has no link, student only a student, company only a company."""
    bad = T.user_account.where(wrong_links())
    return _rows(bad, "role_link", "user_account", key_text(["user_id"]), F.col("role"))


def audit_recruiter_company(T) -> DataFrame:
    """K8: a job's recruiter works for another company."""
    r = T.recruiter.select("recruiter_id", F.col("company_id").alias("recruiter_company"))
    bad = T.job.join(r, "recruiter_id").where(F.col("recruiter_company") != F.col("company_id"))
    return _rows(bad, "recruiter_company", "job", key_text(["job_id"]),
                 F.concat(F.lit("recruiter_company="), F.col("recruiter_company").cast("string")))


def audit_offer_gate(T) -> DataFrame:
    """K9: an offer on an application that is not Selected."""
    a = T.application.select("application_id", "status")
    bad = T.offer.join(a, "application_id").where(F.col("status") != "Selected")
    return _rows(bad, "offer_gate", "offer", key_text(["offer_id"]),
                 F.concat(F.lit("status="), F.col("status")))


def audit_application_rules(T, as_of=DEFAULT_AS_OF) -> DataFrame:
    """Stored applications that the eligibility rules would refuse."""
    pairs = T.application.select("application_id", "student_id", "job_id")
    bad = eligibility_pairs(T, pairs, as_of).where(~F.col("eligible"))
    return _rows(bad, "application_rules", "application", key_text(["application_id"]),
                 F.array_join("reasons", " | "))


def _row_findings(spec: TableSpec) -> list[Column]:
    """What is wrong with one row by itself: (rule, key, detail) or null, a column per rule."""
    pk = key_text(spec.primary_key)

    def finding(bad: Column, rule: str, detail: Column) -> Column:
        return F.when(bad, F.struct(F.lit(rule).alias("rule"), pk.alias("key"), detail.alias("detail")))
    null_pk = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.primary_key])
    out = [finding(null_pk, "pk_null", F.lit(""))]
    out += [finding(~F.coalesce(F.expr(c.predicate), F.lit(True)), "check_failed", F.lit(c.name)) for c in spec.checks]
    out += [finding(F.col(c).isNotNull() & ~F.col(c).isin(*values), "domain", F.concat(F.lit(c + "="), F.col(c)))
            for c, values in spec.domains.items()]
    out += [finding(cond, rule, F.lit(c)) for c, rule, cond in _profile_checks(spec)]
    if spec.name == "user_account":
        out.append(finding(wrong_links(), "role_link", F.col("role")))
    return out


def _key_claims(spec: TableSpec) -> list[Column]:
    """The unique keys that a row claims: (rule, key, detail), null where a part of the key is."""
    def claim(cols, rule: str) -> Column:
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        return F.when(present, F.struct(F.lit(rule).alias("rule"), key_text(cols).alias("key"),
                                        F.lit(",".join(cols)).alias("detail")))
    return [claim(spec.primary_key, "pk_duplicate"), *[claim(cols, "unique_duplicate") for cols in spec.unique]]


def audit_table_rules(T) -> DataFrame:
    """K1, K2, K4 to K7 as one report, every table read once.

    A row is expanded into its findings and the keys that it claims; all are counted in one
    aggregate (partial first). A finding stands with the number of its rows, a claim if several
    rows make it.
    """
    out = []
    for spec in TABLES.values():
        entries = [F.when(c.isNotNull(), F.struct(F.lit(claimed).alias("claimed"), c.alias("e")))
                   for claimed, cols in ((False, _row_findings(spec)), (True, _key_claims(spec))) for c in cols]
        every = T.table(spec.name).select(F.explode(F.array_compact(F.array(*entries))).alias("x"))
        counted = every.groupBy("x.claimed", "x.e.rule", "x.e.key", "x.e.detail").agg(F.count("*").alias("n_rows"))
        out.append(counted.where("NOT claimed OR n_rows > 1").select(
            "rule", F.lit(spec.name).alias("table_name"), "key", "detail", "n_rows"))
    return reduce(DataFrame.unionByName, out)


AUDITS = {
    "audit_pk": audit_pk,
    "audit_unique": audit_unique,
    "audit_fk": audit_fk,
    "audit_check": audit_check,
    "audit_not_null": audit_not_null,
    "audit_domain": audit_domain,
    "audit_role_link": audit_role_link,
    "audit_recruiter_company": audit_recruiter_company,
    "audit_offer_gate": audit_offer_gate,
    "audit_application_rules": audit_application_rules,
}


def audit_all(T) -> DataFrame:
    """Every row-level audit in one report (the K5 profile is separate)."""
    return reduce(DataFrame.unionByName,
                  [fn(T) for name, fn in AUDITS.items() if name != "audit_not_null"])
