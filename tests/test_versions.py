"""The version log: whole versions only, one winner, old ones readable; routes that build on each other."""

from __future__ import annotations

import uuid
from collections import Counter

import pytest

from hireflow.operators import audit as K
from hireflow.operators import changesets as CS
from hireflow.operators.ranking import fresh_ids
from hireflow.session import shared_path
from hireflow.sources.binding import Domain
from hireflow.sources.versions import VersionLog, VersionTaken

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def log(spark):
    return VersionLog(spark, shared_path(spark, "versions-test", uuid.uuid4().hex))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_version_names_every_table_and_old_ones_stay(spark, log):
    a, b, c = (spark.createDataFrame([(k,)], "x long") for k in (1, 2, 3))
    assert log.latest() == 0 and log.manifest() == {}
    log.commit({"one": a, "two": b}, 0)
    log.commit({"two": c}, 1)
    assert log.versions() == [1, 2]
    assert rows(log.read("one")) == [(1,)] and rows(log.read("two")) == [(3,)]
    assert rows(log.read("two", version=1)) == [(2,)]
    assert log.manifest(1)["one"] == log.manifest(2)["one"]        # untouched tables are not written again


def test_the_second_of_two_batches_from_one_version_loses(spark, log):
    df = spark.createDataFrame([(1,)], "x long")
    log.commit({"t": df}, 0)
    log.commit({"t": df}, 1)
    with pytest.raises(VersionTaken):
        log.commit({"t": spark.createDataFrame([(9,)], "x long")}, 1)
    assert log.latest() == 2 and rows(log.read("t")) == [(1,)]


def test_a_batch_that_dies_leaves_the_version_before(spark, log):
    df = spark.createDataFrame([(1,)], "x long")
    log.commit({"t": df}, 0)
    bad = df.selectExpr("raise_error('lost')  AS x")
    with pytest.raises(Exception, match="lost"):
        log.commit({"t": spark.createDataFrame([(2,)], "x long"), "u": bad}, 1)
    assert log.latest() == 1 and rows(log.read("t")) == [(1,)] and "u" not in log.manifest()


def test_fresh_ids_are_gapless_above_the_highest(spark):
    base = spark.createDataFrame([(7,), (None,), (3,)], "id long")
    new = spark.createDataFrame([(k % 5, f"r{k}") for k in range(500)], "o long, r string").repartition(6)
    got = fresh_ids(new, base, "id", "o", "r").collect()
    assert [(r.o, r.r) for r in sorted(got, key=lambda r: r.id)] == sorted((k % 5, f"r{k}") for k in range(500))
    assert sorted(r.id for r in got) == list(range(8, 508))
    assert rows(fresh_ids(new.limit(1), base.limit(0), "id", "o").select("id")) == [(1,)]


RULES = ["audit_pk", "audit_unique", "audit_fk", "audit_check", "audit_not_null", "audit_domain", "audit_role_link",
         "audit_recruiter_company"]


def violations(T):
    found = Counter()
    for name in RULES:
        found.update(tuple(r) for r in K.AUDITS[name](T).collect())
    return found


def test_every_new_route_keeps_the_rules(spark, log):
    """Routes run one after the other on the log; no version breaks a rule that the data kept before."""
    T = Domain(spark, SF)
    before = violations(T)
    for route in ("register_companies", "edit_student_profiles", "post_jobs", "add_certifications", "apply_for_jobs",
                  "schedule_interviews", "edit_interviews", "edit_offers"):
        log.run(T, CS.ROUTES[route])
    assert not violations(log.open(T)) - before
    now = log.open(T)
    assert now.application.count() > T.application.count() and now.job.count() > T.job.count()


def test_workflow_batches_see_each_other(spark, log):
    T = Domain(spark, SF)
    last = CS.hiring_workflow(T, log)
    assert last == 3 and rows(log.read("application", 1)) != rows(log.read("application", 2))
    selected = {r.application_id for r in log.read("application").filter("status = 'Selected'").collect()}
    old = {r.offer_id for r in T.offer.collect()}
    new = [r for r in log.read("offer").collect() if r.offer_id not in old]
    assert new and all(r.application_id in selected for r in new)
