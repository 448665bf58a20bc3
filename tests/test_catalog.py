"""Every named query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from syndilake import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = ("events", "pages", "documents", "orders", "part")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else (round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else str(v))
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    got = rows_of(frame.columns, frame.collect())
    if name not in catalog.SQL:
        assert got
        return
    answer = duck.execute(catalog.SQL[name])
    assert got == rows_of([d[0] for d in answer.description], answer.fetchall())
