"""Every query with an SQL counterpart gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from stratalake import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_match(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    q = duck.execute(ORACLES[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
