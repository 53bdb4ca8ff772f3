"""Every query against its SQL in DuckDB, on the smallest tables."""

import sys
import warnings
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from packetloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_as_in_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(repr, r)) for r in df.select(columns).collect())
    found = tables.execute(registry.SQL[name])
    place = [[d[0] for d in found.description].index(c) for c in columns]
    assert ours == sorted(tuple(repr(r[i]) for i in place) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry_goes_without_a_missing_library(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("packetloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert set(__spark_entry__.queries()) == set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) == set(registry.SQL)
