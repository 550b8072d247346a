"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from consensa.plans.registry import all_oracles, all_queries

SF = os.environ.get("CONSENSA_TEST_SF", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES = all_queries()
ORACLES = all_oracles()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((repr(tuple(_norm(r[i]) for i in order)) for r in rows)), [cols[i] for i in order]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "pred_label" in df.columns


def test_all_are_registered():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_every_query_has_an_oracle_or_is_rows_only():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"reduce_dims", "ds_unsupervised_converged"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    s_rows, s_cols = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLES[name])
    d_rows, d_cols = _rows([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows
