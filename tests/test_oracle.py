"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sonoframe.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


def same(spark, query, sql):
    df = query(spark, str(DATA))
    names = sorted(df.columns)
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = db.execute(sql)
    at = [[d[0] for d in got.description].index(n) for n in names]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((plain(r) for r in df.select(*names).collect()), key=key) == sorted((plain([r[i] for i in at]) for r in got.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
