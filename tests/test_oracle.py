"""Every core query on the smallest tables: against DuckDB where it has SQL, else that it runs and keeps its schema."""

import importlib
import os
from pathlib import Path

import duckdb
import pytest

from lexmill.plans import catalog

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


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name in catalog.SQL:
        result = duck.execute(catalog.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows(got) == rows([tuple(r[i] for i in order) for r in result.fetchall()])
    assert got or name in ("first_pairs",)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 1 and df.first().tokens > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_training_data_package():
    root = Path(catalog.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p


def test_entry_lives_without_the_training_data_package(monkeypatch):
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.setattr(entry, "_training_data", lambda: None)
    assert set(entry.queries()) == set(catalog.QUERIES)
