"""Every query of the catalogue against its DuckDB equivalent on the small tables."""

import datetime
import decimal
import pathlib

import duckdb
import pytest

from palimpsest import catalog

ENTRIES = catalog.entries()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}") + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(k for k, e in ENTRIES.items() if e.sql))
def test_matches_sql(spark, sf_dir, duck, name):
    got = ENTRIES[name].run(spark, sf_dir)
    want = duck.execute(ENTRIES[name].sql)
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(k for k, e in ENTRIES.items() if not e.sql))
def test_runs(spark, sf_dir, name):
    got = ENTRIES[name].run(spark, sf_dir)
    assert got.count() >= 0
