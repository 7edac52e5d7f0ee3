"""Every registered query with SQL gives the same rows in both engines."""

import oracle
import pytest

import __spark_entry__ as driver

SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    assert oracle.difference(driver.queries()[name](spark, data), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert driver.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["ordinal", "label", "value", "color"]
