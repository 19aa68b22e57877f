"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from veridag.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, views, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    want = views.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table(rows, df.columns) == table(want.fetchall(), want.columns)
