"""Every registered query but the training-data ones, on the smallest tables, against its SQL in DuckDB."""

import os

import pytest

from quillmere.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return "~" if value is None or value != value else f"{value:.6g}" if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in by) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    got = found.collect()
    assert got, "a query without rows shows nothing"
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(found.columns) == sorted(columns)
        assert rows_of(found.columns, got) == rows_of(columns, want.fetchall())
