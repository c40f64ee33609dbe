"""Every query with an oracle gives DuckDB's rows; shuffled input gives the same result."""

import math

import duckdb
import pytest

from marlstone import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    done = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    expected = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in done.fetchall())
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, sf, name):
    df = plans.queries()[name](spark, sf)
    n = df.count()
    assert n == 0 if name == "population_violations" else n > 0
