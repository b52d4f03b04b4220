"""Every registered query against its SQL, and properties that SQL can't express."""

import math
from collections import Counter

import duckdb
import pytest
from docloom.plans import registered

QUERIES, SQL = registered()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(plain(tuple(r)) for r in df.select(*columns).collect())
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert got == Counter(plain(r) for r in want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
