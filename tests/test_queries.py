"""Every query of the library against its SQL on the smallest tables, or for rows where it has none."""

import pytest
from compare import connect, same

from ctxforge.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    frame = QUERIES[name](spark, sf)
    if name in SQL:
        same(frame, con, SQL[name])
    else:
        assert frame.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_reports_parse_files_once(spark, sf):
    """Reports of files and of their directory read one parsed table; only the ranking makes files of its own."""
    made = catalog.queries()["render_reports"](spark, sf)
    assert made._jdf.queryExecution().executedPlan().toString().count("part.parquet") == 1
