"""Every query runs on the smallest tables; where there is SQL, DuckDB gives the same rows."""

import glob
import os

import duckdb
import pytest

from corpusloom import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in queries.ORACLES:
        ran = duck.execute(queries.ORACLES[name])
        names = [c[0] for c in ran.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, ran.fetchall())
    else:
        assert got


def test_flagship(spark):
    assert queries.flagship(spark, DATA).count() == 20
