"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from waymark.plans import catalog

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plain(rows, names, order):
    at = [names.index(c) for c in order]
    norm = lambda v: (None if math.isnan(v) else round(v + 0.0, 3)) if isinstance(v, float) else v
    return sorted(repr(tuple(norm(r[i]) for i in at)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(D):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{D}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    rel = duck.sql(catalog.oracle_sql()[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    assert plain(df.collect(), df.columns, order) == plain(rel.fetchall(), list(rel.columns), order)
