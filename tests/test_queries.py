"""Every query with SQL against DuckDB at the smallest scale; those without must give rows."""

import math

import duckdb
import pytest

import tarn.plans as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool | int | str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(name, spark, duck):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(plans.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in place) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y))), (a, b)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_gives_rows(name, spark):
    assert plans.QUERIES[name](spark, SF).count() > 0
