"""Every registered analytics query against its SQL in DuckDB, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sightline.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return f"{float(value):.9g}" if isinstance(value, (int,)) or type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(want.columns).collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.columns and rows.count() > 0


def test_entry_runs_without_llm_folders(tmp_path):
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())
    # A copy without the folders and the pipeline lists the same analytics queries.
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "sightline", tmp_path / "sightline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": os.environ["PATH"], "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))]
