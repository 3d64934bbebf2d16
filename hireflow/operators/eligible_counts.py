"""Exact eligibility counts for all jobs and all students (E2, E3), and rank intervals.

How many students are eligible for each job, and how many jobs each student is
eligible for, without listing a single (student, job) pair or pair of skill sets.
Students stand in order of falling CGPA, so those who reach a job's minimum are the first
``cut`` of them; a bitmap index (``skill_index``) counts among them those with all the
skills that the job requires. Per student the same index is built over the jobs in order
of rising minimum, those with the same minimum and skills as one. Pairs are decided one by one only when they are asked for
(``eligibility.eligibility_pairs``).

The rules are those of E1: required skills that the skill table does not list do not
count, a job that requires nothing suits every student, any CGPA value is compared as
it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eligibility import DEFAULT_AS_OF, accepting, cgpa_at_least_counts
from .ranking import distinct_ranks, positions, running_totals
from .skill_index import count_holders, count_within


def _sets(owners: DataFrame, key: str, skills: DataFrame) -> DataFrame:
    """``owners`` with their sorted distinct skill ids (empty if none)."""
    held = skills.groupBy(key).agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))
    none = F.array().cast("array<bigint>")
    return owners.join(held, key, "left").withColumn("skills", F.coalesce("skills", none))


def _listed_needs(T) -> DataFrame:
    return T.job_skill.join(T.skill.select("skill_id"), "skill_id", "left_semi")


def students_by_cgpa(T) -> DataFrame:
    """student_id, cgpa_x100, place: from the highest CGPA (0), ties by id, unknown CGPA last."""
    return positions(T.student.select("student_id", "cgpa_x100"), F.col("cgpa_x100").desc_nulls_last(), "student_id",
                     name="place")


def _held_places(T, ranked: DataFrame) -> DataFrame:
    return (T.student_skill.select("student_id", "skill_id").distinct()
            .join(ranked.select("student_id", "place"), "student_id").select("place", "skill_id"))


def students_per_job(T, jobs: DataFrame) -> DataFrame:
    """job_id, eligible_students: students with all required skills and the minimum CGPA."""
    asked = _sets(cgpa_at_least_counts(T, jobs.select("job_id", "min_cgpa_x100")), "job_id", _listed_needs(T))
    return count_holders(asked.select("job_id", "skills", F.col("n_at_least").alias("cut")),
                         _held_places(T, students_by_cgpa(T))).select("job_id", F.col("n").alias("eligible_students"))


def eligible_students_per_job(T, as_of=DEFAULT_AS_OF) -> DataFrame:
    """E3 as counts: every open job whose deadline has not passed."""
    return students_per_job(T, T.job.where(accepting(F.col("status"), F.col("application_deadline"), as_of)))


def skill_holders_per_job(T) -> DataFrame:
    """E2 as counts: students who hold all skills of each job, whatever their CGPA."""
    everyone = T.student.agg(F.count("*").alias("cut"))
    asked = _sets(T.job.select("job_id"), "job_id", _listed_needs(T)).withColumn("cut", everyone.scalar())
    return count_holders(asked, _held_places(T, students_by_cgpa(T))).select(
        "job_id", F.size("skills").alias("n_skills"), F.col("n").alias("students_with_all_skills"))


def eligible_jobs_per_student(T, as_of=DEFAULT_AS_OF) -> DataFrame:
    """student_id, eligible_jobs: open, in-date jobs that the student is eligible for."""
    jobs = (T.job.where(accepting(F.col("status"), F.col("application_deadline"), as_of))
            .where(F.col("min_cgpa_x100").isNotNull()).select("job_id", "min_cgpa_x100"))
    # Jobs with one minimum and one set of skills suit the same students: they are one place with a weight.
    alike = (_sets(jobs, "job_id", _listed_needs(T)).groupBy("min_cgpa_x100", "skills").agg(F.count("*").alias("weight")))
    ranked = positions(alike, "min_cgpa_x100", name="place")
    needs = ranked.select("place", F.explode("skills").alias("skill_id"))
    # How many places ask for at most each CGPA: the jobs' minima and the students' values on one line.
    students = T.student.select("student_id", "cgpa_x100")
    line = (ranked.select(F.col("min_cgpa_x100").alias("v"), F.lit(1).cast("long").alias("n"))
            .unionByName(students.select(F.col("cgpa_x100").alias("v"), F.lit(0).cast("long").alias("n"))
                         .where("v IS NOT NULL").distinct()))
    cuts = running_totals(line, "v", "n", name="cut").withColumnRenamed("v", "cgpa_x100")
    asked = _sets(students.join(cuts, "cgpa_x100", "left").withColumn("cut", F.coalesce("cut", F.lit(0))),
                  "student_id", T.student_skill.select("student_id", "skill_id"))
    return count_within(asked.select("student_id", "skills", "cut"), needs, ranked.select("place", "weight")).select(
        "student_id", F.col("n").alias("eligible_jobs"))


def student_cgpa_ranks(T) -> DataFrame:
    """Every student's place in the order of falling CGPA (from 1) and the dense rank of the CGPA."""
    ranks = distinct_ranks(T.student.select("cgpa_x100"), "cgpa_x100", name="cgpa_rank", descending=True)
    value = ranks.select(F.col("cgpa_x100").alias("v"), "cgpa_rank")
    placed = students_by_cgpa(T)
    return placed.join(value, placed.cgpa_x100.eqNullSafe(value.v)).select(
        "student_id", "cgpa_x100", (F.col("place") + 1).alias("place"), "cgpa_rank")


def cgpa_rank_intervals(T) -> DataFrame:
    """Q42 without its product: per open job the students who reach its minimum, as an interval of places.

    They are the places 1 to ``last_place`` of ``student_cgpa_ranks`` (null where nobody reaches it), from
    ``first_student_id`` to ``last_student_id``; ``last_rank`` is the lowest dense rank of a CGPA that does.
    Whether one student reaches one job's minimum is a comparison of two numbers.
    """
    jobs = cgpa_at_least_counts(T, T.job.where(F.col("status") == "Open").select("job_id", "min_cgpa_x100"))
    ranked = student_cgpa_ranks(T)
    # Distinct ends only meet the students: jobs that share one share its row.
    ends = jobs.select(F.col("n_at_least").alias("place")).where("place > 0").distinct()
    last = ranked.join(ends, "place").select(F.col("place").alias("n_at_least"), F.col("student_id").alias("last_student_id"),
                                             F.col("cgpa_rank").alias("last_rank"))
    first = ranked.where("place = 1").select("student_id").scalar()
    return jobs.join(last, "n_at_least", "left").select(
        "job_id", "min_cgpa_x100", F.expr("nullif(n_at_least, 0)").alias("last_place"),
        F.when(F.col("n_at_least") > 0, first).alias("first_student_id"), "last_student_id", "last_rank")
