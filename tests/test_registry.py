"""Every query runs; those with SQL agree with it."""

import math
import os

import duckdb
import pytest
from structura import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else (round(v, 7) + 0.0 if isinstance(v, float) else v)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str), sorted(names)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert df.columns and len(set(df.columns)) == len(df.columns)
        return
    cur = db.execute(registry.ORACLES[name])
    want, want_names = canonical(cur.fetchall(), [d[0] for d in cur.description])
    got, got_names = canonical(rows, df.columns)
    assert got_names == want_names
    assert got == want
