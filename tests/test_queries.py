"""Every named query against its DuckDB text on the smallest tables."""
import pytest

import __spark_entry__ as E
from check_queries import compare, connect
from roamlog.session import drop_staged, staged_count

#: Queries without a row in the smallest tables.
EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_text_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, sf_dir, name):
    before = staged_count()
    try:
        assert compare(spark, con, name, sf_dir) == ("no rows" if name in EMPTY else "")
    finally:
        drop_staged(spark, before)


def test_entry(spark):
    assert E.entry(spark).count() > 0
