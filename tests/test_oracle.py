"""Every named query next to its SQL twin on the smallest tables."""

from pathlib import Path

import check_oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def connection():
    return check_oracle.oracle_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    function, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert function(spark, FOLDER).count() > 0
        return
    same, message = check_oracle.compare(spark, connection, name, function, sql, FOLDER)
    assert same, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
