"""Paged lists, batch search and the one-scan audit on small tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hireflow.operators import audit as K
from hireflow.operators.lists import paged
from hireflow.operators.search import search_many


def test_paged_lists_with_a_hot_parent(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3, 7, 7, 7, 7]), rng.randrange(20), k) for k in range(800)]
    df = spark.createDataFrame(rows, "parent long, at long, id long").repartition(5)
    got = paged(df, "parent", F.col("at").desc(), "id", page=25).collect()
    for parent in (1, 2, 3, 7):
        want = sorted((r for r in rows if r[0] == parent), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r.parent == parent), key=lambda r: r.position)
        assert [r.id for r in mine] == [r[2] for r in want]
        assert [(r.position, r.page) for r in mine] == [(i + 1, i // 25 + 1) for i in range(len(want))]
    assert len(got) == sum(r[0] is not None for r in rows)


def test_search_equals_contains(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "ab", "%_", "Émile été", *["".join(rng.choice("abcAB 1é") for _ in range(rng.randrange(1, 30)))
                                                       for _ in range(150)]]
    terms = [None, "", "a", "B", "ab", "é", " ", "b 1", "abc", "aBcA", "zzz", "zz", "%", "émile été", "a" * 40,
             *[t[1:1 + k] for k in (1, 2, 3, 5) for t in texts[60:90]]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.term, r.id) for r in search_many(rows, "id", "text", asked).collect()}
    assert got == {(t.lower(), k) for t in terms if t for k, x in enumerate(texts) if x and t.lower() in x.lower()}


def test_one_scan_audit_finds_what_the_single_audits_find(seed):
    spark = seed.spark
    student = seed.student.unionByName(seed.student.limit(1)).unionByName(
        seed.student.limit(1).withColumn("student_id", F.lit(None).cast("long")).withColumn("cgpa_x100", F.lit(1100)))
    account = seed.user_account.unionByName(seed.user_account.limit(1).withColumn("user_id", F.lit(-5).cast("long"))
                                            .withColumn("role", F.lit("GUEST")))
    T = seed.with_tables(student=student, user_account=account)
    found = {(r.rule, r.table_name, r.key) for r in K.audit_table_rules(T).collect()}
    for audit in (K.audit_pk, K.audit_unique, K.audit_check, K.audit_domain, K.audit_role_link):
        rows = {(r.rule, r.table_name, r.key) for r in audit(T).collect()}
        assert rows <= found, audit.__name__
    assert {"pk_duplicate", "pk_null", "check_failed", "role_link", "unique_duplicate"} <= {f[0] for f in found}
    assert spark is not None
