"""The corpus queries that SQL can express give their twin's rows, without Python workers where they are native."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from marketlens.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(frame):
    """Rows as tuples, columns and rows in order, missing values as None."""
    rows = frame[sorted(frame.columns)].astype(object).itertuples(index=False)
    rows = [tuple(None if v is None or v is pd.NA or v != v else v for v in row) for row in rows]
    return sorted(rows, key=lambda row: tuple((v is not None, v) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if name.startswith(("op1_", "op8_")):
        assert "Python" not in plan and "Arrow" not in plan
    want = con.execute(ORACLE[name]).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
