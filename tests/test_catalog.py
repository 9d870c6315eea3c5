"""Every query with SQL against DuckDB on the smallest tables; the others give rows, and are held against plain versions in test_plain_queries and test_surface."""

import pytest
from conftest import SF

from voxlake.plans import catalog


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 8)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_duckdb(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_without_optional_parts(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(catalog.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
