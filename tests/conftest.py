from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hireflow.session import build_session
    import tempfile
    s = build_session("local[4]", app_name="hireflow-tests", shuffle_partitions=8,
                      extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="hireflow-wh-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from tests.fixture import SeedDomain
    return SeedDomain(spark)
