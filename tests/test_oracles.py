"""Every registered query against its SQL on the smallest test tables."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(spark, duck, name, FOLDER) is None


def test_links_reach_all_tables(spark):
    links = {(r.left_table, r.left_column, r.right_table, r.right_column) for r in QUERIES["join_links"](spark, FOLDER).collect()}
    assert ("documents", "doc_id", "labels", "doc_id") in links


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert len(ORACLES) >= len(QUERIES)
