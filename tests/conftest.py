import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nestgrain.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("nestgrain-tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def tiny_tasks(spark):
    """Force the range-partitioned form of ordered operators."""
    spark.conf.set("nestgrain.rowsPerTask", "40")
    yield
    spark.conf.unset("nestgrain.rowsPerTask")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
