"""The driver's contract, and every query against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from millrace.plans import catalogue


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return str(int(v)) if float(v).is_integer() else f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    got = sorted(tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = duck.sql(catalogue.ORACLE[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == sorted(df.columns)
    want = sorted(tuple(_plain(r[at[c]]) for c in sorted(df.columns)) for r in rel.limit(10**9).fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry_point.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_core_does_not_import_the_corpus_subpackage():
    root = Path(catalogue.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text().split(), p
            assert ".llm" not in p.read_text(), p
