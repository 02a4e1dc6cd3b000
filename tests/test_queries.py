"""Every registered query against its SQL, over whole tables of the smallest data set."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as registered
from protomatch_checks.catalog import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("supplier", "part", "orders", "lineitem", "documents", "benchmark", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data missing")


def plain(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def sorted_rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


# Compared with brute force in test_gapped: SQL takes minutes for the candidates of short seed words.
WITHOUT_SQL = {"q37_gapped_search"}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(registered.queries())
    assert set(QUERIES) - WITHOUT_SQL == set(registered.oracle_sql()) & set(QUERIES)


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(registered.__file__))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True)
    assert run.stdout.split() == [str(len(QUERIES)), str(len(QUERIES) - len(WITHOUT_SQL))]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WITHOUT_SQL])
def test_query_equals_its_sql(spark, duck, name):
    df = registered.queries()[name](spark, DATA)
    cursor = duck.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, cursor.fetchall())


def test_entry_gives_rows(spark):
    assert registered.entry(spark).count() > 0
