"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in plans.SQL:
        assert got
        return
    res = db.execute(plans.SQL[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    assert sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in res.fetchall()) == got
