"""Every registered query against its oracle on the smallest data set."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as driver
from webposture.plans.oracle import ORACLE
from webposture.plans.workload import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, driver.queries()[name], driver.oracle_sql()[name], SF) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
