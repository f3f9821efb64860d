"""Every named query against its SQL on the smallest shared tables."""

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    status, _ = compare.compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert status in ("ok", "rows"), status


def test_entry_has_rows_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["email_address", "phone_number", "ip_address", "username", "misc"]
    assert df.count() > 0


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
