"""Every registered query against its SQL twin on the given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(entry.QUERIES) == set(entry.ORACLES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "failures" in df.columns


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_same_rows(spark, con, name):
    verdict, _, _ = compare(spark, con, name, SF)
    assert verdict == "ok"
