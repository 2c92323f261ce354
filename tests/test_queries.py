"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from shelfmark import catalogue_queries, server_queries, text_queries  # noqa: F401

DATA = os.environ.get("SHELFMARK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    return float(value) if isinstance(value, (int, float)) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue_queries.queries()))
def test_query_equals_sql(spark, name):
    frame = catalogue_queries.queries()[name](spark, DATA)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    result = con.execute(catalogue_queries.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(names, result.fetchall())
