"""Bucketed stored domain: same answers, and key joins without shuffles."""

from __future__ import annotations

import contextlib
import io
import os

import pytest

from hireflow.operators import catalogue as C
from hireflow.operators import reports as R
from hireflow.sources.binding import Domain
from hireflow.sources.store import materialize

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="testdata not present")


@pytest.fixture(scope="module")
def stored(spark):
    T = Domain(spark, SF_DIR)
    return T, materialize(T, "hireflow_store_test", buckets=8)


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_stored_domain_gives_the_same_report(stored):
    T, S = stored
    a = sorted(map(tuple, C.q63_workflow_report(T).collect()), key=repr)
    b = sorted(map(tuple, C.q63_workflow_report(S).collect()), key=repr)
    assert a == b


def test_bucketed_key_join_has_no_shuffle(spark, stored):
    _, S = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        j = S.application.join(S.interview, "application_id")
        j.write.format("noop").mode("overwrite").save()
        plan = _plan(j)
        assert "SortMergeJoin" in plan
        assert "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_operators_run_on_stored_tables(stored):
    T, S = stored
    assert R.latest_interview(S).count() == R.latest_interview(T).count()
