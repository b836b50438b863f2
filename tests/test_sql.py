"""Every query against the same result in SQL, on the smallest given tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "events", "embeddings"]

if not os.path.isdir(SF_DIR):
    pytest.skip("no test tables", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402

from episode_oracle import ORACLE  # noqa: E402
from episode_queries import QUERIES  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = table(df.collect(), df.columns)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == table(cur.fetchall(), names)
    assert got


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
