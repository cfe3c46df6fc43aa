"""Every query of the store against its DuckDB equivalent on the small tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.oracle import ORACLE_SQL
from tidemark.plans.queries import QUERIES

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{AT}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_all_queries_have_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, AT)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == Counter(want.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r.key for r in rows] == sorted(r.key for r in rows)


def test_the_rest_imports_without_the_optional_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) == set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
