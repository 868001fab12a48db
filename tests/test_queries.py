"""Every registered query against the same in SQL, over the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from wardstone.plans import all_queries, registry  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "0" if abs(v) < 1e-12 else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted([shown(v) for v in r] for r in df.select(*columns).collect())
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    found = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted([shown(r[i]) for i in order] for r in found.fetchall())
