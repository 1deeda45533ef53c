"""Every query that SQL can express gives SQL's rows."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
ORACLES = {k: v for k, v in entry_module.oracle_sql().items() if not (k[0] == "p" and k[1].isdigit())}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    same_columns, got, want = compare(spark, con, entry_module.queries()[name], ORACLES[name], FOLDER)
    assert same_columns
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
