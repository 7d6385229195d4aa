"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_points
from trialbook.plans import check

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    pytest.importorskip("duckdb")
    return check.duck(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    result = QUERIES[name](spark, small)
    if name in SQL:
        assert check.difference(result, duck, SQL[name]) is None
    else:
        assert result.count() > 0


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    names = [r["type"] for r in entry_points.entry(spark).collect()]
    assert "Overall" in names and len(names) == 6
