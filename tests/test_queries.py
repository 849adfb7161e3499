"""Every registered query with a SQL twin, at the smallest scale, and the driver contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from speechlake import queries

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{float(x):.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, duck, name):
    frame, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([plain(r[c]) for c in columns] for r in frame.collect()) == sorted([plain(r[k]) for k in at] for r in want.fetchall())
    spark.catalog.clearCache()


def test_contract(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_the_rest_stands_without_the_corpus_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def missing(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("speechlake.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", missing)
    again = importlib.reload(sys.modules["__spark_entry__"])
    assert set(again.queries()) == set(queries.QUERIES)
    monkeypatch.undo()
    importlib.reload(again)


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(queries.__file__).parent
    for p in root.rglob("*.py"):
        assert "llm" in p.parts or "speechlake.llm" not in p.read_text()
