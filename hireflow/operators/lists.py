"""Ordered child lists in pages: interviews of an application, jobs of a company, certifications
of a student.

Children are placed in one order over all parents (``ranking.positions``: range partitions, so a
parent with very many children spreads over tasks); a child's place in its list is its position less
the parent's first one, and a page is a run of ``PAGE`` places. No list is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import positions
from .reports import skills_by_job

PAGE = 20


def paged(children: DataFrame, parent: str, *order: Column | str, page: int = PAGE) -> DataFrame:
    """``children`` with position (from 1) in their parent's list and its page (from 1).

    Children without a parent are a list of their own only if ``parent`` is not null; others are left out.
    """
    placed = positions(children.where(F.col(parent).isNotNull()), parent, *order, name="_p")
    first = placed.groupBy(parent).agg(F.min("_p").alias("_first"))
    at = F.col("_p") - F.col("_first")
    return (placed.join(first, parent)
            .withColumn("position", at + 1).withColumn("page", F.expr(f"(_p - _first) div {int(page)} + 1"))
            .drop("_p", "_first"))


def application_interviews(T) -> DataFrame:
    """The interviews of every application by date and time."""
    return paged(T.interview, "application_id", F.col("interview_date").asc_nulls_first(),
                 F.col("interview_time").asc_nulls_first(), "interview_id")


def company_jobs(T) -> DataFrame:
    """E11, company side: the jobs of every company, newest (highest id) first, with their skills."""
    skills = F.coalesce(F.array_join("required_skills", ", "), F.lit("")).alias("skills_text")
    listed = paged(T.job.drop("description", "recruiter_id"), "company_id", F.col("job_id").desc())
    return listed.join(skills_by_job(T), "job_id", "left").select(*listed.columns, skills)


def student_certifications(T) -> DataFrame:
    """The certifications of every student, newest first."""
    return paged(T.certification, "student_id", F.col("issue_date").desc_nulls_last(), F.col("certification_id").desc())
