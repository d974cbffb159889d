"""Each query that has SQL against DuckDB, on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidelog.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x is pd.NA or x != x else int(x) if isinstance(x, float) and x == int(x) else x.item() if hasattr(x, "item") else x
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())
