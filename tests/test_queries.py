"""Every registered query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got
        return
    cur = db.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    """Both folders gone: the entry imports and lists all other queries, with the pipeline's module there or not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("lodestar", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(root, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert not any(x.startswith('op') for x in n) and 'pipeline' not in n; print(len(n), set(e.oracle_sql()) <= n)"
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
        assert run.returncode == 0, run.stderr
        assert run.stdout.split() == [str(sum(not x.startswith("op") and x != "pipeline" for x in QUERIES)), "True"]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["req_id", "row_num", "id", "score", "relevancy"]
