import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelloom.cluster import drop_scratch, local_session  # noqa: E402

# A few rows per test: fewer cores start faster than they help.
CORES = os.environ.get("TEST_CORES", "8")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", CORES, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_scratch(session)


@pytest.fixture(scope="session")
def make(spark):
    """``make("a int, b string", row, row)`` -> DataFrame."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build
