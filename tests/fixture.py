"""A small hand-written domain of the reference's shape (own rows).

Edge rows on purpose: a job with no skills, a student with no skills, CGPA
equal to a job's minimum, CGPA 10.00, a deadline on the as-of day, a closed
and an overdue job, two interviews on the same date, a NULL expiry, an
interview pointing at a missing application, a repeated (student, job) pair.
"""

from __future__ import annotations

import datetime as dt

from hireflow.sources.schema import TABLES

D = dt.date

ROWS = {
    "department": [(1, "CSE"), (2, "ECE"), (3, "MECH")],
    "skill": [(1, "Python"), (2, "SQL"), (3, "Java"), (4, "Excel")],
    "company": [(1, "Acme", "IT", "Pune", "https://acme.example", "hr@acme.example"),
                (2, "Beta", "Finance", "Delhi", None, "jobs@beta.example")],
    "student": [(1, "Asha", "asha@uni.example", D(2003, 1, 5), 910, 2025, 1),
                (2, "Bala", "bala@uni.example", D(2003, 2, 6), 700, 2025, 1),
                (3, "Chitra", "chitra@uni.example", D(2002, 3, 7), 1000, 2024, 2),
                (4, "Dev", "dev@uni.example", D(2003, 4, 8), 800, 2026, 3)],
    "recruiter": [(11, 1, "Ravi"), (12, 1, "Rina"), (21, 2, "Sam")],
    "job": [(1, 1, 11, "Data Analyst", "Full-time", "d", "Pune", 800, D(2026, 10, 20), 30000.0, "Open"),
            (2, 2, 21, "Java Dev", "Full-time", "d", "Delhi", 750, D(2026, 12, 31), 40000.0, "Open"),
            (3, 1, 11, "Intern", "Internship", "d", "Pune", 700, D(2026, 12, 31), 10000.0, "Open"),
            (4, 2, 21, "Old Role", "Full-time", "d", "Delhi", 600, D(2026, 12, 31), 20000.0, "Closed"),
            (5, 2, 12, "Overdue", "Contract", "d", "Delhi", 700, D(2026, 9, 30), 25000.0, "Open")],
    "student_skill": [(1, 1, "Advanced"), (1, 2, "Intermediate"), (2, 1, "Beginner"),
                      (3, 3, "Advanced"), (3, 2, "Beginner"), (3, 1, "Intermediate")],
    "job_skill": [(1, 1), (1, 2), (2, 3)],
    "certification": [(100, 1, "Cloud", "Org", D(2025, 1, 1), None),
                      (101, 3, "Java", "Org", D(2025, 1, 1), D(2024, 1, 1))],
    "application": [(10, 1, 1, D(2026, 9, 1), "Applied"),
                    (11, 2, 1, D(2026, 9, 2), "Rejected"),
                    (12, 3, 2, D(2026, 9, 3), "Selected"),
                    (13, 1, 3, D(2026, 9, 4), "Shortlisted"),
                    (14, 2, 1, D(2026, 9, 5), "Applied")],
    "interview": [("i1", 10, D(2026, 9, 10), 36000, "Online", "Completed", None),
                  ("i2", 10, D(2026, 9, 10), 50400, "In-person", "Scheduled", "second"),
                  ("i3", 12, D(2026, 9, 12), 36000, "Online", "Completed", "ok"),
                  ("i4", 99, D(2026, 9, 12), 36000, "Online", "Scheduled", None)],
    "offer": [(500, 12, D(2026, 9, 20), "Java Dev", 40000.0, D(2026, 10, 1), "Pending")],
    "user_account": [(-1, "admin@uni.example", "ADMIN", None, None),
                     (2, "asha@uni.example", "STUDENT", 1, None),
                     (4, "bala@uni.example", "STUDENT", 2, None),
                     (6, "chitra@uni.example", "STUDENT", 3, None),
                     (8, "dev@uni.example", "STUDENT", 4, None),
                     (3, "hr@acme.example", "COMPANY", None, 1),
                     (5, "jobs@beta.example", "COMPANY", None, 2)],
}

REQUESTS = [  # request_id, student_id, job_id, ts
    (1, 3, 1, dt.datetime(2026, 9, 30, 9)),   # eligible, not applied -> accepted
    (2, 3, 1, dt.datetime(2026, 9, 30, 10)),  # same pair later -> duplicate
    (3, 1, 1, dt.datetime(2026, 9, 30, 11)),  # eligible but applied -> already applied
    (4, 2, 1, dt.datetime(2026, 9, 30, 12)),  # CGPA + missing SQL
    (5, 9, 1, dt.datetime(2026, 9, 30, 13)),  # unknown student
    (6, 4, 5, dt.datetime(2026, 9, 30, 14)),  # overdue at 2026-10-01
]

STATUS_CHANGES = [  # change_id, application_id, company_id, status, ts
    ("c1", 10, 1, "Shortlisted", dt.datetime(2026, 9, 11)),
    ("c2", 10, 1, "Selected", dt.datetime(2026, 9, 12)),
    ("c3", 10, 2, "Rejected", dt.datetime(2026, 9, 13)),   # foreign company: refused
    ("c4", 11, 1, "On hold", dt.datetime(2026, 9, 13)),    # outside the domain: refused
    ("c5", 12, 2, "Rejected", dt.datetime(2026, 9, 14)),
    ("c6", 12, 2, "Selected", dt.datetime(2026, 9, 13)),   # older than c5
]


class SeedDomain:
    """Same interface as ``sources.binding.Domain``, over the rows above."""

    def __init__(self, spark):
        self.spark = spark
        for name, rows in ROWS.items():
            setattr(self, name, spark.createDataFrame(rows, TABLES[name].schema))
        self.application_request = spark.createDataFrame(
            REQUESTS, "request_id bigint, student_id bigint, job_id bigint, ts timestamp_ntz")
        self.status_change = spark.createDataFrame(
            STATUS_CHANGES,
            "change_id string, application_id bigint, company_id bigint, status string, "
            "ts timestamp_ntz")

    def table(self, name):
        return getattr(self, name)

    def with_tables(self, **frames):
        d = SeedDomain.__new__(SeedDomain)
        d.__dict__.update(self.__dict__)
        d.__dict__.update(frames)
        return d
