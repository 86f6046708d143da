"""Every registered query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tallyfold import catalog

DATA = "/root/testdata/sf0.001"


def canonical(rows: list, columns: list[str]) -> list[tuple]:
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert canonical([r.asDict() for r in got.collect()], columns) == canonical(rows, columns)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_known_totals(spark):
    got = catalog.QUERIES["reclaimable_totals"](spark, DATA).first()
    assert (got["n_groups"], got["reclaimable"], got["n_copies"]) == (10, 29_443, 11)
