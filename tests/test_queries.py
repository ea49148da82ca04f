"""Every query with SQL against DuckDB at the smallest size: columns, rows and values."""

import math

import duckdb
import pytest

from gridlore.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    c = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(x)]) for x in cols) for r in c.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-5) for x, y in zip(a, b)), (a, b)
