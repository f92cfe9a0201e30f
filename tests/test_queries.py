"""Every registered query against its check SQL on the smallest test set."""

import datetime
import decimal
import math

import duckdb
import pytest

from watchfold.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def queries():
    return catalog.queries()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf, duck, queries):
    df = queries[name](spark, sf)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert ours == theirs


def test_no_oracle_without_query(queries):
    assert set(ORACLES) <= set(queries)
