"""The training-data queries on the smallest tables: against DuckDB where they have SQL, else that they run."""

import os
from pathlib import Path

import duckdb
import pytest

from lexmill.llm import queries

DATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(found):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in queries.SQL:
        result = duck.execute(queries.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows(got) == rows([tuple(r[i] for i in order) for r in result.fetchall()])
    if name.endswith("_found"):
        assert len(got) == len(set(got))
