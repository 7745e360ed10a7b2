"""Every registered query of the library against its SQL, on the small tables."""

from __future__ import annotations

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return float(value) if isinstance(value, Decimal) else value


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, views, name):
    df = registry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    found = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    told = views.sql(registry.oracle_sql()[name])
    assert sorted(told.columns) == columns
    expected = [tuple(map(plain, r)) for r in told.project(", ".join(f'"{c}"' for c in columns)).fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_queries_without_sql_give_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, str(SF)).count() > 0, name


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.queries()
