"""Every registered query against the same question in SQL."""

import pytest
from compare import TESTDATA, connect, differences

import __spark_entry__ as contract
from cohortline.entries import ENTRIES


@pytest.fixture(scope="module")
def con():
    return connect(TESTDATA)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, TESTDATA)
    assert differences(df, con, contract.oracle_sql()[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_flagship_numbers(spark):
    rows = contract.queries()["funnel_weekly_cohort"](spark, "/root/testdata/sf0.01").collect()
    assert [tuple(r)[1:] for r in rows] == [(141, 117, 72, 70, 36), (9, 8, 2, 2, 1)]
