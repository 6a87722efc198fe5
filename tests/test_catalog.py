"""Every registered relational query against its SQL."""

import glob
import os

import duckdb
import pytest

from sievewright.plans import catalog, sources

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(names, values):
    by = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in by) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL | sources.SQL))
def test_query_equals_sql(spark, duck, name):
    df = (catalog.QUERIES | sources.QUERIES)[name](spark, DATA)
    got = duck.execute((catalog.SQL | sources.SQL)[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())
