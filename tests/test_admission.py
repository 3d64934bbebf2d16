"""Ordered admission under several unique keys against a row-by-row simulation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hireflow.operators.admission import admit_in_order
from hireflow.operators.intake import intake_companies, intake_students
from hireflow.sources.binding import Domain

SF = "/root/testdata/sf0.001"


def one_by_one(rows, keys):
    """Rows are (order, owner, *values); returns order -> keys that refuse it."""
    held, out = [], {}
    for order, owner, *values in sorted(rows):
        late = [k for k in range(keys) if values[k] is not None
                and any(h[k] == values[k] and w != owner for w, h in held)]
        out[order] = late
        if not late:
            held.append((owner, values))
    return out


def run(spark, rows, keys, owner):
    names = [f"k{i}" for i in range(keys)]
    df = spark.createDataFrame(rows, "form_id long, own long, " + ", ".join(f"{n} string" for n in names)).repartition(4)
    got = admit_in_order(df, [[n] for n in names], owner="own" if owner else None)
    return {r.form_id: r.refused_by for r in got.collect()}


@pytest.mark.parametrize("seed,keys,values,owners", [(1, 2, 40, 0), (2, 3, 25, 0), (3, 2, 12, 8), (4, 3, 60, 5), (5, 1, 9, 0)])
def test_random_batches(spark, seed, keys, values, owners):
    rng = random.Random(seed)
    rows = [(k * 3, rng.randrange(owners) if owners else k * 3,
             *[rng.choice([None, *[f"v{rng.randrange(values)}"] * 6]) for _ in range(keys)]) for k in range(120)]
    assert run(spark, rows, keys, owners) == one_by_one(rows, keys)


def test_chains_and_a_value_of_every_third_row(spark):
    chain = [(k, k, f"e{(k + 1) // 2}", f"i{k // 2}") for k in range(12)]      # each row meets the next
    hot = [(100 + k, 100 + k, "hot" if k % 3 == 0 else f"h{k}", f"j{k // 2}") for k in range(90)]
    rows = chain + hot
    got = run(spark, rows, 2, False)
    assert got == one_by_one(rows, 2)
    assert [k for k in range(12) if not got[k]] == [0, 2, 4, 6, 8, 10]


def test_empty_and_uncontested(spark):
    assert run(spark, [], 2, False) == {}
    assert run(spark, [(1, 1, "a", None), (2, 2, "b", None)], 2, False) == {1: [], 2: []}


FORM = ("form_id long, student_id string, name string, email string, phone string, dob string, cgpa string, "
        "graduation_year string, department_id string")


def test_a_refused_form_blocks_no_valid_one(spark):
    """Form 2 is refused for its id, so its email stays free for form 3."""
    T = Domain(spark, SF)
    rest = ("A", "", "2000-01-01", "8.0", "2022", "1")
    form = lambda k, sid, email: (k, sid, rest[0], email, *rest[1:])
    batch = spark.createDataFrame([form(1, "9000000001", "e1@x.org"), form(2, "9000000001", "e2@x.org"),
                                   form(3, "9000000003", "e2@x.org"), form(4, "9000000004", "e1@x.org")], FORM)
    accepted, quarantined = intake_students(T, batch)
    assert sorted(r.form_id for r in accepted.collect()) == [1, 3]
    assert {r.form_id: r.reasons for r in quarantined.collect()} == {
        2: ["student id appears earlier in the batch"], 4: ["email appears earlier in the batch"]}


def test_company_edits_hold_email_and_name(spark):
    T = Domain(spark, SF)
    cols = ["form_id", "company_id", "user_id", "website", "phone", "company_name", "industry", "location", "email"]
    ids = [r.company_id for r in T.company.select("company_id").orderBy("company_id").limit(3).collect()]
    row = lambda k, c, name, email: (k, c, c * 2 + 1, "", "", name, "I", "L", email)
    a, b, c = ids
    batch = spark.createDataFrame([row(1, a, "N1", "m1@x.org"), row(2, b, "N1", "m2@x.org"), row(3, c, "N3", "m2@x.org"),
                                   row(4, a, "N1", "m9@x.org")], cols)
    accepted, quarantined = intake_companies(T, batch)
    assert sorted(r.form_id for r in accepted.collect()) == [1, 3, 4]
    assert [(r.form_id, r.reasons) for r in quarantined.collect()] == [
        (2, ["company name appears earlier in the batch for another company"])]


def test_every_form_ends_on_one_side(spark):
    T = Domain(spark, SF)
    accepted, quarantined = intake_students(T)
    both = accepted.select("form_id").union(quarantined.select("form_id"))
    assert both.count() == T.student_form.count() == both.distinct().count()
    assert quarantined.filter(F.size("reasons") == 0).isEmpty()
