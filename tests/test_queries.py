"""Every registered query with SQL gives the rows that DuckDB gives for it; the rest run and have a stable schema."""

from __future__ import annotations

import datetime
import decimal
import math

import pytest

from quire.plans import catalog

from .conftest import DATA


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, decimal.Decimal):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    asked = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in asked.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, asked.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, name):
    df = catalog.queries()[name](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
