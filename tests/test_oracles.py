"""Every registered query against its SQL in DuckDB, or for rows where there is no SQL."""

import pytest

import __spark_entry__ as entry
import check


@pytest.fixture(scope="module")
def duck(sf):
    con = check.connect(sf)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, sf, name):
    verdict, _, _ = check.compare(spark, duck, sf, name)
    assert verdict.startswith(("ok", "rows")) and not verdict.endswith(" 0"), verdict


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
