"""Oracle SQL: the bound domain as DuckDB common table expressions.

The driver's oracle only knows the raw testdata views, so every oracle query
carries the domain definitions as CTEs in front of its own text. These are
written as SQL, separately from ``sources/binding.py``; an oracle match checks
the binding as well as the operator.
"""

from __future__ import annotations

import re

BINDING = {
    "department": """
        SELECT CAST(n_nationkey AS BIGINT) AS department_id, n_name AS department_name
        FROM nation""",
    "student": """
        SELECT c_custkey AS student_id, c_name AS name,
               lower(c_name) || '@campus.example' AS email,
               DATE '1998-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS dob,
               CAST(floor((c_acctbal + 1000) / 11.0) AS INTEGER) AS cgpa_x100,
               CAST(2018 + c_custkey % 8 AS INTEGER) AS graduation_year,
               CAST(c_nationkey AS BIGINT) AS department_id
        FROM customer""",
    "company": """
        SELECT s.s_suppkey AS company_id, s.s_name AS company_name, r.r_name AS industry,
               n.n_name AS location,
               'https://supplier' || CAST(s.s_suppkey AS VARCHAR) || '.example' AS website,
               'hr' || CAST(s.s_suppkey AS VARCHAR) || '@company.example' AS email
        FROM supplier s
        JOIN nation n ON s.s_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "skill": """
        SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS skill_id,
               p_brand AS skill_name
        FROM part""",
    "recruiter": """
        SELECT DISTINCT l_suppkey * 10 + l_linenumber AS recruiter_id, l_suppkey AS company_id,
               'Recruiter ' || CAST(l_suppkey * 10 + l_linenumber AS VARCHAR) AS recruiter_name
        FROM lineitem""",
    "job": """
        SELECT p.p_partkey AS job_id, a.company_id,
               a.company_id * 10 + (p.p_size % 7 + 1) AS recruiter_id,
               p.p_name AS job_title, p.p_type AS job_type,
               p.p_type || ' ' || p.p_name AS description,
               n.n_name AS location, p.p_size * 20 AS min_cgpa_x100,
               a.application_deadline, p.p_retailprice AS salary,
               CASE WHEN p.p_size % 5 = 0 THEN 'Closed' ELSE 'Open' END AS status
        FROM part p
        JOIN (SELECT l_partkey, min(l_suppkey) AS company_id,
                     CAST(max(l_shipdate) AS DATE) AS application_deadline
              FROM lineitem GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey
        JOIN nation n ON n.n_nationkey = p.p_partkey % 25""",
    "job_skill": """
        SELECT DISTINCT a.p_partkey AS job_id,
               CAST(regexp_extract(b.p_brand, '([0-9]+)$', 1) AS BIGINT) AS skill_id
        FROM part a JOIN part b
          ON b.p_partkey BETWEEN a.p_partkey AND a.p_partkey + (a.p_size % 4) - 1""",
    "student_skill": """
        SELECT o.o_custkey AS student_id,
               CAST(regexp_extract(p.p_brand, '([0-9]+)$', 1) AS BIGINT) AS skill_id,
               CASE WHEN max(l.l_linenumber) <= 2 THEN 'Beginner'
                    WHEN max(l.l_linenumber) <= 5 THEN 'Intermediate'
                    ELSE 'Advanced' END AS proficiency
        FROM orders o
        JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        JOIN part p ON p.p_partkey = l.l_partkey
        WHERE l.l_discount >= 0.05
        GROUP BY o.o_custkey, p.p_brand""",
    "application": """
        SELECT o.o_orderkey AS application_id, o.o_custkey AS student_id, x.job_id,
               CAST(o.o_orderdate AS DATE) AS application_date,
               CASE WHEN o.o_orderstatus = 'F' THEN 'Selected'
                    WHEN o.o_orderstatus = 'P' THEN 'Applied'
                    WHEN substr(o.o_orderpriority, 1, 1) IN ('1', '2') THEN 'Shortlisted'
                    ELSE 'Rejected' END AS status
        FROM orders o
        JOIN (SELECT l_orderkey, min(l_partkey) AS job_id FROM lineitem GROUP BY l_orderkey) x
          ON x.l_orderkey = o.o_orderkey
        WHERE o.o_custkey % 7 <> 0""",
    "interview": """
        SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
               CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-' ||
               CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS interview_id,
               l_orderkey AS application_id, CAST(l_shipdate AS DATE) AS interview_date,
               28800 + CAST(l_quantity AS INTEGER) * 600 AS interview_time,
               CASE WHEN l_linestatus = 'O' THEN 'Online' ELSE 'In-person' END AS mode,
               CASE WHEN l_linenumber % 3 = 0 THEN 'Scheduled'
                    WHEN l_linenumber % 3 = 1 THEN 'Completed'
                    ELSE 'Cancelled' END AS interview_status,
               CASE WHEN l_discount < 0.05 THEN NULL
                    ELSE 'Round ' || CAST(l_linenumber AS VARCHAR) END AS remarks
        FROM lineitem WHERE l_returnflag = 'R'""",
    "offer": """
        SELECT a.application_id AS offer_id, a.application_id,
               a.application_date + 14 AS offer_date,
               'Offer ' || CAST(a.application_id AS VARCHAR) AS job_title,
               min(l.l_extendedprice) AS salary,
               a.application_date + 45 AS joining_date,
               CASE WHEN a.application_id % 3 = 0 THEN 'Pending'
                    WHEN a.application_id % 3 = 1 THEN 'Accepted'
                    ELSE 'Withdrawn' END AS offer_status
        FROM application a JOIN lineitem l ON l.l_orderkey = a.application_id
        WHERE a.status = 'Selected' AND l.l_returnflag = 'A'
        GROUP BY a.application_id, a.application_date""",
    "certification": """
        SELECT o.o_orderkey AS certification_id, o.o_custkey AS student_id,
               o.o_orderpriority AS certification_name,
               'Board ' || o.o_orderstatus AS issuing_organization,
               CAST(o.o_orderdate AS DATE) AS issue_date, x.expiry_date
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS expiry_date
                   FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey
        WHERE o.o_custkey % 7 = 0""",
    "user_account": """
        SELECT c_custkey * 2 AS user_id, lower(c_name) || '@campus.example' AS email,
               'STUDENT' AS role, c_custkey AS student_id, CAST(NULL AS BIGINT) AS company_id
        FROM customer
        UNION ALL
        SELECT s_suppkey * 2 + 1, 'hr' || CAST(s_suppkey AS VARCHAR) || '@company.example',
               'COMPANY', CAST(NULL AS BIGINT), s_suppkey
        FROM supplier
        UNION ALL
        SELECT CAST(-1 AS BIGINT), 'admin@campus.example', 'ADMIN',
               CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)""",
    "application_request": """
        SELECT event_id AS request_id, user_id AS student_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_id, ts
        FROM events""",
    "status_change": """
        SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' ||
               CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) || '-' ||
               CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) AS change_id,
               a.application_id,
               CASE WHEN l.l_linenumber = 1 THEN l.l_suppkey ELSE j.company_id END AS company_id,
               CASE l.l_linenumber % 5 WHEN 0 THEN 'Applied' WHEN 1 THEN 'Shortlisted'
                    WHEN 2 THEN 'Selected' WHEN 3 THEN 'Rejected' ELSE 'On hold' END AS status,
               l.l_shipdate + to_minutes(CAST(l.l_linenumber AS BIGINT)) AS ts
        FROM lineitem l
        JOIN application a ON l.l_orderkey = a.application_id
        JOIN job j ON j.job_id = a.job_id
        WHERE l.l_returnflag = 'N'""",
}

FORMS = {
    "student_form": """
        SELECT c_custkey AS form_id, CASE WHEN c_custkey % 73 = 0 THEN 'abc' WHEN c_custkey % 79 = 0 THEN CAST(c_custkey AS VARCHAR)
                    ELSE CAST(c_custkey + 1000000000 - CASE WHEN c_custkey % 83 = 0 THEN 1 ELSE 0 END AS VARCHAR)
               END AS student_id,
               CASE WHEN c_custkey % 97 = 0 THEN '   ' WHEN c_custkey % 67 = 0 THEN NULL
                    WHEN c_custkey % 71 = 0 THEN repeat('n', 121) ELSE '  ' || c_name || ' ' END AS name,
               CASE WHEN c_custkey % 89 = 0 THEN 'no-at-sign.example'
                    WHEN c_custkey % 50 = 0 THEN upper(lower(c_name) || '@campus.example')
                    WHEN c_custkey % 31 <= 1
                         THEN 'twin' || CAST(c_custkey // 31 AS VARCHAR) || '@campus.example'
                    ELSE ' New.' || c_name || '@Campus.Example ' END AS email,
               CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'call me'
                    ELSE '+91 ' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS phone,
               CASE WHEN c_custkey % 17 = 0 THEN '2001-02-30'
                    ELSE CAST(1995 + c_custkey % 10 AS VARCHAR) || '-' ||
                         CAST(1 + c_custkey % 12 AS VARCHAR) || '-' ||
                         CAST(1 + c_custkey % 28 AS VARCHAR) END AS dob,
               CASE WHEN c_custkey % 101 = 0 THEN 'NaN' WHEN c_custkey % 103 = 0 THEN '-1.50'
                    WHEN c_custkey % 47 = 0 THEN '10.004' WHEN c_custkey % 61 = 0 THEN NULL
                    WHEN c_custkey % 43 = 0 THEN '85e-1'
                    ELSE CAST((c_custkey * 37) % 1100 // 100 AS VARCHAR) || '.' ||
                         lpad(CAST((c_custkey * 37) % 1100 % 100 AS VARCHAR), 2, '0') END AS cgpa,
               CAST(1890 + (c_custkey * 7) % 320 AS VARCHAR) AS graduation_year,
               CASE WHEN c_custkey % 19 = 0 THEN '99'
                    ELSE CAST(c_nationkey AS VARCHAR) END AS department_id,
               CASE WHEN c_custkey % 4 = 0
                         THEN CAST([] AS STRUCT(skill_id VARCHAR, proficiency VARCHAR)[])
                    WHEN c_custkey % 53 = 0
                         THEN [{'skill_id': CAST(c_custkey % 25 + 1 AS VARCHAR),
                                'proficiency': CASE WHEN c_custkey % 59 = 0 THEN 'Guru'
                                                    WHEN c_custkey % 3 = 0 THEN 'Beginner'
                                                    WHEN c_custkey % 3 = 1 THEN 'Intermediate'
                                                    ELSE 'Advanced' END},
                               {'skill_id': CAST((c_custkey * 3) % 25 + 1 AS VARCHAR),
                                'proficiency': 'Beginner'},
                               {'skill_id': '999', 'proficiency': 'Beginner'}]
                    ELSE [{'skill_id': CAST(c_custkey % 25 + 1 AS VARCHAR),
                           'proficiency': CASE WHEN c_custkey % 59 = 0 THEN 'Guru'
                                               WHEN c_custkey % 3 = 0 THEN 'Beginner'
                                               WHEN c_custkey % 3 = 1 THEN 'Intermediate'
                                               ELSE 'Advanced' END},
                          {'skill_id': CAST((c_custkey * 3) % 25 + 1 AS VARCHAR),
                           'proficiency': 'Beginner'}] END AS skills
        FROM customer""",
    "company_form": """
        SELECT s_suppkey AS form_id, s_suppkey AS company_id, s_suppkey * 2 + 1 AS user_id,
               CASE WHEN s_suppkey % 11 = 0
                    THEN 'Supplier#' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0')
                    ELSE ' ' || s_name END AS company_name,
               CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'Manufacturing' END AS industry,
               'NATION_' || CAST(s_nationkey AS VARCHAR) AS location,
               CASE WHEN s_suppkey % 5 = 0 THEN 'ftp://files.example' WHEN s_suppkey % 5 = 1 THEN ''
                    ELSE 'https://s' || CAST(s_suppkey AS VARCHAR) || '.example' END AS website,
               CASE WHEN s_suppkey % 9 = 0
                         THEN 'hr' || CAST(s_suppkey + 1 AS VARCHAR) || '@company.example'
                    WHEN s_suppkey % 8 = 0 THEN 'bad email'
                    ELSE ' HR' || CAST(s_suppkey AS VARCHAR) || '@Company.Example ' END AS email,
               CASE WHEN s_suppkey % 4 = 0 THEN '12'
                    ELSE '(080) 555-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') END AS phone
        FROM supplier""",
    "job_form": """
        SELECT p.p_partkey AS form_id, p.p_partkey AS job_id, j.company_id,
               CAST(j.company_id * 10 + (p.p_size % 7 + 1) AS VARCHAR) AS recruiter_id,
               CASE WHEN p.p_partkey % 23 = 0 THEN '' ELSE p.p_name END AS job_title,
               p.p_type AS job_type, 'Updated ' || p.p_name AS description,
               'NATION_' || CAST(p.p_partkey % 25 AS VARCHAR) AS location,
               CASE WHEN p.p_partkey % 13 = 0 THEN '11.00' WHEN p.p_partkey % 53 = 0 THEN '-0.004'
                    ELSE CAST(p.p_size // 5 AS VARCHAR) || '.50' END AS minimum_cgpa,
               CASE WHEN p.p_partkey % 17 = 0 THEN '-5' WHEN p.p_partkey % 19 = 0 THEN 'NaN'
                    ELSE CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS VARCHAR) || '.00' END AS salary,
               CASE WHEN p.p_partkey % 29 = 0 THEN '2001-13-01'
                    ELSE '2001-' || CAST(1 + p.p_partkey % 12 AS VARCHAR) || '-15' END AS deadline,
               CASE WHEN p.p_partkey % 31 = 0 THEN 'Paused' WHEN p.p_partkey % 43 = 0 THEN NULL WHEN p.p_size % 5 = 0 THEN 'Closed'
                    ELSE 'Open' END AS status,
               CASE WHEN p.p_partkey % 37 = 0
                         THEN [p.p_partkey % 25 + 1, (p.p_partkey * 7) % 25 + 1, 999]
                    WHEN p.p_partkey % 2 = 0
                         THEN [p.p_partkey % 25 + 1, (p.p_partkey * 7) % 25 + 1, p.p_partkey % 25 + 1]
                    ELSE [p.p_partkey % 25 + 1, (p.p_partkey * 7) % 25 + 1] END AS skills
        FROM part p JOIN job j ON j.job_id = p.p_partkey""",
    "certification_form": """
        SELECT o_orderkey AS form_id, CAST(o_custkey AS VARCHAR) AS student_id,
               CASE WHEN o_orderkey % 41 = 0 THEN ' ' WHEN o_orderkey % 47 = 0 THEN NULL ELSE o_orderpriority END AS certification_name,
               'Board ' || o_orderstatus AS issuing_organization,
               CASE WHEN o_orderkey % 43 = 0 THEN 'someday'
                    ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS issue_date,
               CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN '1990-01-01'
                    ELSE strftime(CAST(o_orderdate AS DATE) + 365, '%Y-%m-%d') END AS expiry_date
        FROM orders""",
    "interview_form": """
        SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' ||
               CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) || '-' ||
               CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) AS form_id,
               CAST(l.l_orderkey AS VARCHAR) AS application_id,
               CASE WHEN l.l_linenumber = 1 THEN l.l_suppkey ELSE j.company_id END AS company_id,
               CASE WHEN l.l_linenumber = 7 THEN 'tomorrow'
                    ELSE strftime(CAST(l.l_shipdate AS DATE), '%Y-%m-%d') END AS interview_date,
               CAST(8 + CAST(l.l_quantity AS INTEGER) % 12 AS VARCHAR) || ':' ||
               CASE WHEN l.l_linenumber = 6 THEN '75' ELSE '30' END AS interview_time,
               CASE WHEN l.l_linenumber = 5 THEN 'Phone' WHEN l.l_linestatus = 'O' THEN 'Online'
                    ELSE 'In-person' END AS mode,
               CASE WHEN l.l_linenumber = 3 THEN 'Done' ELSE 'Scheduled' END AS interview_status,
               CASE WHEN l.l_linenumber = 4 THEN repeat('x', 501) ELSE '' END AS remarks
        FROM lineitem l
        LEFT JOIN application a ON a.application_id = l.l_orderkey
        LEFT JOIN job j ON j.job_id = a.job_id
        WHERE l.l_returnflag = 'A'""",
    "offer_form": """
        SELECT a.application_id AS form_id, CAST(a.application_id AS VARCHAR) AS application_id,
               j.company_id,
               strftime(a.application_date + 10, '%Y-%m-%d') AS offer_date,
               CASE WHEN a.application_id % 43 = 0 THEN repeat('T', 151)
                    ELSE 'Offer ' || CAST(a.application_id AS VARCHAR) END AS job_title,
               CASE WHEN a.application_id % 11 = 0 THEN '-1' ELSE '50000.00' END AS salary,
               CASE WHEN a.application_id % 7 = 0 THEN strftime(a.application_date + 5, '%Y-%m-%d')
                    ELSE strftime(a.application_date + 40, '%Y-%m-%d') END AS joining_date,
               CASE WHEN a.application_id % 13 = 0 THEN 'Maybe' ELSE 'Pending' END AS offer_status
        FROM application a JOIN job j ON j.job_id = a.job_id""",
    "student_skill_form": """
        SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-' ||
               CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) || '-' ||
               CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR) AS form_id,
               o.o_custkey AS student_id,
               CAST(CASE WHEN l.l_linenumber = 7 THEN 999
                         ELSE CAST(regexp_extract(p.p_brand, '([0-9]+)$', 1) AS BIGINT) END
                    AS VARCHAR) AS skill_id,
               CASE l.l_linenumber % 4 WHEN 0 THEN 'Expert' WHEN 1 THEN 'Beginner'
                    WHEN 2 THEN 'Intermediate' ELSE 'Advanced' END AS proficiency,
               l.l_linenumber % 2 = 0 AS allow_update
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN part p ON p.p_partkey = l.l_partkey
        WHERE l.l_discount < 0.05""",
    "company_registration_form": """
        SELECT s_suppkey AS form_id,
               CASE WHEN s_suppkey % 10 = 0 THEN s_name
                    WHEN s_suppkey % 14 <= 1 THEN 'Twin Works ' || CAST(s_suppkey // 14 AS VARCHAR)
                    ELSE ' New ' || s_name || ' ' END AS company_name,
               CASE WHEN s_suppkey % 12 > 0 THEN 'Services' END AS industry,
               'NATION_' || CAST(s_nationkey AS VARCHAR) AS location,
               CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'https://n' || CAST(s_suppkey AS VARCHAR) || '.example' END AS website,
               CASE WHEN s_suppkey % 13 = 0 THEN 'hr' || CAST(s_suppkey AS VARCHAR) || '@company.example'
                    WHEN s_suppkey % 15 <= 1 THEN 'Team' || CAST(s_suppkey // 15 AS VARCHAR) || '@new.example'
                    ELSE ' Jobs' || CAST(s_suppkey AS VARCHAR) || '@New.Example ' END AS email
        FROM supplier""",
    "interview_edit_form": """
        SELECT i.interview_id AS form_id, CAST(i.application_id AS VARCHAR) AS application_id,
               j.company_id + CAST(i.application_id % 6 = 0 AS INTEGER) AS company_id,
               CASE WHEN i.application_id % 11 = 0 THEN 'someday'
                    ELSE strftime(i.interview_date + 7, '%Y-%m-%d') END AS interview_date,
               CASE WHEN i.application_id % 13 = 0 THEN '25:00' ELSE '9:30' END AS interview_time,
               CASE WHEN i.application_id % 17 = 0 THEN 'Phone' ELSE 'Online' END AS mode,
               CASE WHEN i.application_id % 4 = 1 THEN 'Cancelled' ELSE 'Completed' END AS interview_status,
               CASE WHEN i.application_id % 2 = 0 THEN ' Moved ' ELSE '' END AS remarks
        FROM interview i JOIN application a ON a.application_id = i.application_id JOIN job j ON j.job_id = a.job_id""",
    "offer_edit_form": """
        SELECT o.offer_id AS form_id, CAST(o.application_id AS VARCHAR) AS application_id,
               j.company_id + CAST(o.offer_id % 6 = 0 AS INTEGER) AS company_id,
               strftime(o.offer_date, '%Y-%m-%d') AS offer_date,
               CASE WHEN o.offer_id % 7 = 0 THEN '' ELSE 'Senior ' || o.job_title END AS job_title,
               CASE WHEN o.offer_id % 11 = 0 THEN 'ask' ELSE '61000.50' END AS salary,
               strftime(o.offer_date + CASE WHEN o.offer_id % 5 = 0 THEN -1 ELSE 60 END, '%Y-%m-%d') AS joining_date,
               CASE WHEN o.offer_id % 3 = 0 THEN 'Accepted' ELSE 'Pending' END AS offer_status
        FROM offer o JOIN application a ON a.application_id = o.application_id JOIN job j ON j.job_id = a.job_id""",
}
BINDING.update(FORMS)

# Definition order: a CTE may only use the ones above it.
ORDER = ("department", "student", "company", "skill", "recruiter", "job", "job_skill",
         "student_skill", "application", "interview", "offer", "certification",
         "user_account", "application_request", "status_change", *FORMS)


def _uses(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def with_binding(body: str) -> str:
    """Prefix ``body`` with the CTEs it (transitively) uses."""
    needed: set[str] = set()
    frontier = [n for n in ORDER if _uses(body, n)]
    while frontier:
        name = frontier.pop()
        if name in needed:
            continue
        needed.add(name)
        frontier.extend(n for n in ORDER if n != name and _uses(BINDING[name], n)
                        and n not in needed)
    ctes = [f"{n} AS ({BINDING[n]}\n)" for n in ORDER if n in needed]
    body = body.strip()
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body
