"""Every registered query against its SQL answer on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(entry.SMALLEST)


def test_every_query_has_an_answer():
    assert set(SQL) == set(entry.queries()) - (set(entry.LLM_QUERIES) - set(entry.LLM_ORACLES))


@pytest.mark.parametrize("name", sorted(SQL))
def test_answer(spark, duck, name):
    assert difference(entry.queries()[name](spark, entry.SMALLEST), duck, SQL[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "bottleneck_type" in df.columns
