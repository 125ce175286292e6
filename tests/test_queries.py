import decimal
import math
import os

import duckdb
import pytest

from kinmesh.plans import registry

SQL = registry.oracle_sql()
#: Significant digits of doubles that must agree: both engines add in their own order.
DIGITS = 9


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{sf}/{f}'")
    return c


def rows(columns, data):
    """Sorted rows with columns by name; numbers become floats."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    number = lambda x: isinstance(x, int | float | decimal.Decimal) and not isinstance(x, bool)
    found = [tuple(float(r[k]) if number(r[k]) else r[k] for k in order) for r in data]
    return sorted(found, key=lambda r: repr(tuple(f"{x:.6g}" if isinstance(x, float) else x for x in r)))


def same(a, b):
    return math.isclose(a, b, rel_tol=10**-DIGITS, abs_tol=10**-DIGITS) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert [(x, y) for x, y in zip(got, want, strict=True) if not all(map(same, x, y))] == []


def test_entry_and_registry_agree(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
