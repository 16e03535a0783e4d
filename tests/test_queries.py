"""Every registered query with SQL gives the same rows as its SQL."""

import __spark_entry__ as driver
import pytest
from oracle import database, difference

SF = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(driver.queries()[name](spark, SF), con, SQL[name]) is None


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(driver.queries())
