"""Each query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from callnet.plans import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        path = f"{DIR}/{name}" + ("/*.parquet" if os.path.isdir(f"{DIR}/{name}") else "")
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sql, name):
    got = queries.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = sql.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, [tuple(plain(v) for v in r) for r in want]))


def test_every_query_without_sql_is_an_iteration():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {
        "betweenness", "eigenvector", "top_hubs", "louvain", "community_table", "community_sizes", "louvain_modularity", "small_world",
    }
