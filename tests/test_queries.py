"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folio.plans import registry

DIR = os.environ.get("FOLIO_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in registry.ORACLE_SQL:
        cursor = db.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
