"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from marlstone.plans import oracles
from marlstone.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, con, sf, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    r = con.execute(oracles.ORACLES[name])
    order = [c[0] for c in r.description]
    assert sorted(order) == columns
    want = sorted((tuple(x[order.index(c)] for c in columns) for x in r.fetchall()), key=repr)
    assert got == want
