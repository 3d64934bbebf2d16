"""Eligibility engine: (student, job) decisions with reasons, for whole batches.

E1 ``eligibility_pairs``  decide given pairs, reasons in the reference's order
E4 ``eligible_counts``    per open job, students reaching its CGPA minimum
E5 ``admit_applications`` request batch -> accepted application rows + rejects
(E2 and E3, as exact counts, are in ``eligible_counts``.)

Scale notes. E1 looks up the student (held skills as bit words keyed by word
number) and the job (required skills with word and bit) once per pair, so
the missing skills are a row-local filter: no per-skill join of the pairs.
E4 is a histogram of CGPA values and a sum from the top over range partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import fresh_ids, running_totals

# Fixed values of the reference application: reason and decision texts.
REASON_CGPA = "CGPA requirement not met."
REASON_MISSING = "Missing required skills: "
REASON_CLOSED = "Opportunity is no longer accepting applications."
REASON_NOT_FOUND = "The selected student or opportunity was not found."
DECISION_ELIGIBLE = "Eligible to Apply"
DECISION_ALREADY = "Eligible — Already Applied"
DECISION_NOT_ELIGIBLE = "Not Eligible"

# Engine's own texts for batch admission (the reference handles one request).
REASON_DUPLICATE = "Duplicate request in batch."
REASON_APPLIED = "Already applied."

DEFAULT_AS_OF = "2001-09-01"
MASK_BITS = 63  # bits used per BIGINT word of a skill mask


def _as_of(as_of) -> Column:
    return F.lit(str(as_of)).cast("date")


def accepting(job_status: Column, deadline: Column, as_of) -> Column:
    """Job open and deadline not passed (the deadline day still counts)."""
    return (job_status == "Open") & ~(_as_of(as_of) > deadline)


def applied_pairs(T) -> DataFrame:
    """Distinct (student_id, job_id) that already have an application."""
    return (T.application.select("student_id", "job_id").distinct()
            .withColumn("already_applied", F.lit(True)))


def missing_skills(T, pairs: DataFrame) -> DataFrame:
    """(student_id, job_id, missing_skills sorted by name) for distinct pairs.

    Pairs whose student holds every required skill get no row.
    """
    p = pairs.select("student_id", "job_id").distinct()
    req = T.job_skill.join(T.skill, "skill_id")
    held = T.student_skill.select("student_id", "skill_id")
    return (p.join(req, "job_id")
             .join(held, ["student_id", "skill_id"], "left_anti")
             .groupBy("student_id", "job_id")
             .agg(F.sort_array(F.collect_list("skill_name")).alias("missing_skills")))


def eligibility_pairs(T, pairs: DataFrame, as_of=DEFAULT_AS_OF, keep_unknown: bool = False) -> DataFrame:
    """Decide every row of ``pairs`` (student_id, job_id, any extra columns); ``pairs`` may be a stream.

    Unknown student or job -> no row, as the reference returns nothing there; with ``keep_unknown``
    a row whose only reason says so.
    The student side carries its held skills as bit words keyed by word
    number (a map with at most one entry per held skill) and the job side its
    required skills (sorted by name, each with its word and bit), so after the
    two lookup joins the missing skills are a row-local filter: no per-skill
    join of the pairs, no regrouping, and no driver-side sizing (words are
    taken from the skill ids themselves). ``missing_skills`` is the same rule
    as an anti join, kept as a cross-check.
    """
    s = T.student.select("student_id", "cgpa_x100")
    j = T.job.select("job_id", "min_cgpa_x100", "status", "application_deadline")
    held = skill_masks(T.student_skill.select("student_id", "skill_id"), "student_id")
    s = s.join(held.withColumnRenamed("mask", "held"), "student_id", "left")
    j = j.join(required_by_word(T), "job_id", "left")
    how = "left" if keep_unknown else "inner"
    base = (pairs.join(s.withColumn("_student", F.lit(True)), "student_id", how)
            .join(j.withColumn("_job", F.lit(True)), "job_id", how))
    d = base.withColumn("missing_skills", missing_from_lists(F.col("req"), F.col("held")))
    d = d.join(applied_pairs(T), ["student_id", "job_id"], "left")
    missing = F.coalesce(F.col("missing_skills"), F.array().cast("array<string>"))
    reasons = F.array_compact(F.array(
        F.when(F.col("cgpa_x100") < F.col("min_cgpa_x100"), F.lit(REASON_CGPA)),
        F.when(F.size(missing) > 0,
               F.concat(F.lit(REASON_MISSING), F.array_join(missing, ", "))),
        F.when(~accepting(F.col("status"), F.col("application_deadline"), as_of),
               F.lit(REASON_CLOSED))))
    if keep_unknown:
        reasons = F.when(F.col("_student") & F.col("_job"), reasons).otherwise(F.array(F.lit(REASON_NOT_FOUND)))
    eligible = F.size("reasons") == 0
    already = F.coalesce(F.col("already_applied"), F.lit(False))
    extra = [c for c in pairs.columns if c not in ("student_id", "job_id")]
    return (d.withColumn("reasons", reasons)
             .select(*extra, "student_id", "job_id", "reasons",
                     missing.alias("missing_skills"),
                     eligible.alias("eligible"),
                     already.alias("already_applied"),
                     (eligible & ~already).alias("can_apply"),
                     F.when(eligible & already, DECISION_ALREADY)
                      .when(eligible, DECISION_ELIGIBLE)
                      .otherwise(DECISION_NOT_ELIGIBLE).alias("decision")))


def eligibility_requests(T, as_of=DEFAULT_AS_OF) -> DataFrame:
    """E1 over the whole request stream, arrays flattened to text."""
    r = T.application_request.select("request_id", "student_id", "job_id")
    return eligibility_pairs(T, r, as_of).select(
        "request_id", "student_id", "job_id",
        F.array_join("reasons", " | ").alias("reasons_text"),
        F.array_join("missing_skills", ", ").alias("missing_text"),
        "eligible", "already_applied", "can_apply", "decision")


# --- skill masks --------------------------------------------------------------
def required_by_word(T) -> DataFrame:
    """job_id -> required skills sorted by name, each with the mask word and
    bit of its skill id; bounded by the skill catalogue per job. Required
    skills missing from the skill table are ignored, as the reference's inner
    join with SKILL does."""
    word = F.floor(F.col("skill_id") / MASK_BITS).cast("int")
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(pmod(skill_id, {MASK_BITS}) AS INT))")
    return (T.job_skill.join(T.skill, "skill_id")
            .groupBy("job_id")
            .agg(F.sort_array(F.collect_list(
                F.struct("skill_name", word.alias("word"), bit.alias("bit")))).alias("req")))


def missing_from_lists(req: Column, held: Column) -> Column:
    """Names of required skills whose bit is not held, in name order
    (``held``: map word -> bits; a missing word holds no bits)."""
    missing = F.filter(req, lambda x: F.coalesce(F.element_at(held, x["word"]),
                                                 F.lit(0).cast("bigint"))
                       .bitwiseAND(x["bit"]) == 0)
    return F.transform(missing, lambda x: x["skill_name"])


def skill_masks(rows: DataFrame, key: str) -> DataFrame:
    """(key, mask) with mask a map word -> BIGINT bits of the skill ids held.

    One form for any number or spread of skill ids: the held skills of E1.
    """
    word = F.floor(F.col("skill_id") / MASK_BITS).cast("int")
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(pmod(skill_id, {MASK_BITS}) AS INT))")
    per_word = (rows.select(key, word.alias("w"), bit.alias("b"))
                .groupBy(key, "w").agg(F.bit_or("b").alias("b")))
    return (per_word.groupBy(key)
            .agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("mask")))


def cgpa_at_least_counts(T, jobs: DataFrame) -> DataFrame:
    """``jobs`` + n_at_least = number of students with CGPA >= min_cgpa_x100.

    Histogram of student CGPA (one row per distinct value, map-side combined),
    merged with the distinct job minima and summed up from the top over range
    partitions (``ranking.running_totals``), however many values there are.
    """
    hist = (T.student.groupBy(F.col("cgpa_x100").alias("v"))
            .agg(F.count(F.lit(1)).alias("n")))
    minima = jobs.select(F.col("min_cgpa_x100").alias("v")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    points = hist.unionByName(minima).where("v IS NOT NULL")
    suffix = (running_totals(points, "v", "n", name="n_at_least", descending=True)
              .withColumnRenamed("v", "min_cgpa_x100"))
    return jobs.join(suffix, "min_cgpa_x100")


def eligible_counts(T) -> DataFrame:
    """Per open job: students whose CGPA reaches the job's minimum."""
    jobs = T.job.where(F.col("status") == "Open").select("job_id", "min_cgpa_x100")
    return cgpa_at_least_counts(T, jobs).select(
        "job_id", "min_cgpa_x100", F.col("n_at_least").alias("eligible_students"))


def admit_applications(T, requests: DataFrame, as_of=DEFAULT_AS_OF) -> tuple[DataFrame, DataFrame]:
    """(accepted application rows, rejected requests with reasons).

    One request per (student, job) survives the batch: the earliest by
    (ts, request_id), found with a grouped min (partial aggregation, so a
    pair repeated by a third of the batch is combined map-side). Accepted rows
    get status Applied and ``as_of`` as date, and new ids: the numbers after the highest
    application id, in the order of the requests.
    """
    first = (requests.groupBy("student_id", "job_id")
             .agg(F.min(F.struct("ts", "request_id")).alias("w"))
             .select(F.col("w.request_id").alias("request_id")))
    winners = requests.join(first, "request_id", "left_semi")
    dupes = (requests.join(first, "request_id", "left_anti")
             .select("request_id", "student_id", "job_id",
                     F.array(F.lit(REASON_DUPLICATE)).alias("reasons")))
    decided = eligibility_pairs(T, winners.select("request_id", "student_id", "job_id", "ts"), as_of)
    unknown = (winners.join(decided.select("request_id"), "request_id", "left_anti")
               .select("request_id", "student_id", "job_id",
                       F.array(F.lit(REASON_NOT_FOUND)).alias("reasons")))
    let_in = decided.where("can_apply").select("request_id", "student_id", "job_id", "ts")
    accepted = fresh_ids(let_in, T.application, "application_id", F.col("ts").asc_nulls_first(), "request_id").select(
        "application_id", "student_id", "job_id", _as_of(as_of).alias("application_date"),
        F.lit("Applied").alias("status"), "request_id")
    refused = (decided.where(~F.col("can_apply"))
               .select("request_id", "student_id", "job_id",
                       F.when(F.col("eligible"), F.array(F.lit(REASON_APPLIED)))
                        .otherwise(F.col("reasons")).alias("reasons")))
    rejected = refused.unionByName(dupes).unionByName(unknown)
    return accepted, rejected
