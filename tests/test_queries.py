"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from verification.compare import connect, differences

SF = "/root/testdata/sf0.001"
CHECKED = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    diff = differences(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name])
    spark.catalog.clearCache()
    assert diff is None, diff


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "date"
    assert df.count() == 30


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
