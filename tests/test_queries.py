"""Every registered query against its SQL, on whole tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["station", "awt"]
