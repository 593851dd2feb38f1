"""Every query of the catalogue against its SQL, on whole tables."""

import duckdb
import pytest

from lodestone.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    own = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())
    assert own == theirs
