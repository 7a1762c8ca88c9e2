"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from gridloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_duckdb(spark, duck, name):
    made, want = catalog.QUERIES[name](spark, DATA), duck.sql(catalog.SQL[name])
    columns = sorted(made.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = [tuple(plain(r[c]) for c in columns) for r in made.collect()]
    expected = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_cleaning_plans_have_no_python(spark):
    for name in ("clean_pipeline", "clean_date_normalize", "emails_extract", "text_quality", "dedupe_exact", "invoice_gap_fill"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan, name
