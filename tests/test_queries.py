from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from comparing import compare

from sluicebox.plans import oracle, queries

ROOT = Path(__file__).resolve().parent.parent
SQL = oracle.oracle_sql()
QUERIES = queries.queries()


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_the_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_the_entry_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "sluicebox", tmp_path / "sluicebox", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and not any(n.startswith('op1_') for n in q) and set(s) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=False)
    assert out.returncode == 0 and int(out.stdout) == len(QUERIES), out.stderr
