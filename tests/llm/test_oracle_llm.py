"""The registered corpus queries against DuckDB, where SQL can say the same."""

from pathlib import Path

import duckdb
import pytest

from loomline.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, str(SF))
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    rows = lambda data, columns: sorted((tuple(r[columns.index(c)] for c in names) for r in data), key=repr)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), list(want.columns))
