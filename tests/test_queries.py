"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from marketglass import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6f}"
    return v.isoformat()[:19] if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.mark.parametrize("name", list(plans.SQL))
def test_equals_sql(spark, folder, duck, name):
    r = duck.execute(plans.SQL[name])
    names = sorted(x[0] for x in r.description)
    order = [[x[0] for x in r.description].index(n) for n in names]
    want = sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall())
    df = plans.QUERIES[name](spark, folder)
    assert sorted(df.columns) == names
    assert sorted(tuple(map(plain, row)) for row in df.select(*names).collect()) == want


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n not in plans.SQL])
def test_gives_rows(spark, folder, name):
    assert plans.QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 60
