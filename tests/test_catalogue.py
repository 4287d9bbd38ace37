"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quern import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql := catalogue.oracle_sql().get(name):
        res = duck.execute(sql)
        names = [d[0] for d in res.description]
        theirs = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
        assert sorted(names) == cols and ours == theirs
