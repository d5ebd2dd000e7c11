"""The driver's contract: every query runs on the smallest tables, and those with SQL agree with it."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rollgrid.plans import catalog  # the entry has registered all queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    found = rows([tuple(r) for r in got.collect()], got.columns)
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert found == rows(want.fetchall(), want.columns)


def test_entry_is_a_frame(spark):
    assert entry.entry(spark).count() >= 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """Without the llm folders and the pipeline the entry still imports and lists the other queries."""
    for p in ("rollgrid", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "rollgrid" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
