"""Every query of the catalogue against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomline.plans import catalogue, extensions  # noqa: F401

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted([*catalogue.QUERIES, *catalogue.STORED]))
def test_query(spark, duck, name):
    run, sql = catalogue.STORED.get(name) or (catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    got = run(spark, str(SF))
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert _sorted([tuple(r) for r in got.collect()], got.columns) == _sorted(want.fetchall(), want.columns)
