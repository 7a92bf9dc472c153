"""Every query against its oracle on the smallest data set."""

import datetime
import decimal

import duckdb
import numpy as np
import pytest

from tagloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (int, datetime.datetime)):
        return v
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    got = [[plain(x) for x in r] for r in df.collect()]
    assert name in registry.ORACLE
    result = duck.execute(registry.ORACLE[name])
    columns = [d[0] for d in result.description]
    want = [[plain(x) for x in r] for r in result.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    mine, theirs = ([n.index(c) for c in sorted(columns)] for n in (df.columns, columns))
    assert sorted(repr([r[i] for i in mine]) for r in got) == sorted(repr([r[i] for i in theirs]) for r in want)


def test_entry_gives_rows(spark, data):
    df = registry.QUERIES[registry.FLAGSHIP](spark, data)
    assert df.count() > 0
    assert {"tag", "category", "images", "percent"} <= set(df.columns)
