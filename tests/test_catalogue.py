"""Every registered query against its oracle, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracles

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# The smallest panel has too few days in a row to determine a regression.
NEEDS_MORE_ROWS = {"panel_regression"}


@pytest.fixture(scope="module")
def connections():
    open_ = {}
    for sf_dir in (SMALL, LARGER):
        open_[sf_dir] = duckdb.connect()
        check_oracles.create_views(open_[sf_dir], sf_dir)
    yield open_
    for con in open_.values():
        con.close()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connections, name):
    sf_dir = LARGER if name in NEEDS_MORE_ROWS else SMALL
    assert check_oracles.compare(spark, connections[sf_dir], name, sf_dir) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
