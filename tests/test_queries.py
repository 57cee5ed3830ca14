"""Every query that has SQL gives its rows, on the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck, rows


@pytest.fixture(scope="module")
def db(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, db, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, sf, name):
    d = entry.queries()[name](spark, sf)
    rows = d.limit(5).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
