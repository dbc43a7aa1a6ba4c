"""Every registered query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, plain

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for folder in (SMALL, LARGER):
        schema = folder.rsplit("/", 1)[1].replace(".", "_")
        con.execute(f"CREATE SCHEMA {schema}")
        for t in TABLES:
            con.execute(f"CREATE VIEW {schema}.{t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def folder_of(name: str) -> str:
    """Rules go to the larger data: on the smallest, one basket is support enough."""
    return LARGER if name.startswith("f") else SMALL


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: The corpus queries have their twins tested beside them.
RETAIL = sorted(name for name in entry.oracle_sql() if re.match("[a-z][0-9]{2}_", name))


@pytest.mark.parametrize("name", RETAIL)
def test_query_equals_its_twin(spark, con, name):
    folder = folder_of(name)
    con.execute(f"USE {folder.rsplit('/', 1)[1].replace('.', '_')}")
    df = entry.queries()[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(bad in plan for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))
    got = plain(df.toPandas())
    want = plain(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    a, b = (x.astype(object).where(x.notna(), None) for x in (got, want))
    wrong = (a != b) & ~(a.isna() & b.isna())
    assert not wrong.any(axis=None), (a[wrong.any(axis=1)].head(), b[wrong.any(axis=1)].head())


@pytest.mark.parametrize("library", ["regex", "tokenizers", "xxhash", "sentencepiece.none", "corpus_pipeline", "marketlens.llm"])
def test_retail_queries_do_not_need_the_corpus_libraries(library):
    code = f"import sys; sys.modules[{library!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=Path(entry.__file__).parent, check=True)
    queries, twins = map(int, out.stdout.split())
    retail = [n for n in entry.queries() if re.match("[a-z][0-9]{2}_", n)]
    assert queries >= len(retail) and twins >= len(RETAIL)


def test_flagship(spark):
    assert {r["CustomerGroup"] for r in entry.entry(spark).collect()} <= {"Low-value", "Medium-value", "High-value"}
