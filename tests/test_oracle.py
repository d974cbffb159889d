"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from tidelog.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x == int(x) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["place", "id", "title"]


def test_without_the_training_data_operators(tmp_path):
    """A copy without that subpackage, its tests and the pipeline still has all other queries."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in (("llm",), ("llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and set(o) <= set(q); print(len(q))"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
        assert done.stdout.strip() == str(len(QUERIES)), done.stderr
