"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
import check
from tests.conftest import SMALL

NAMES = sorted(entry_point.queries())


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = check.compare(
        spark, con, SMALL, name, entry_point.queries()[name], entry_point.oracle_sql().get(name)
    )
    assert ok, note


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1


def test_checker_sees_differences(spark, con):
    fn = entry_point.queries()["distinct_serials"]
    sql = entry_point.oracle_sql()["distinct_serials"]
    assert not check.compare(spark, con, SMALL, "x", fn, f"SELECT serial || 'x' AS serial FROM ({sql})")[0]
    assert not check.compare(spark, con, SMALL, "x", fn, f"SELECT serial AS other FROM ({sql})")[0]
    assert not check.compare(spark, con, SMALL, "x", fn, f"SELECT * FROM ({sql}) LIMIT 3")[0]
    assert not check.compare(spark, con, SMALL, "x", fn, f"SELECT 1 AS serial FROM ({sql})")[0]
