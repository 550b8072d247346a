import duckdb
import pytest

from consensa.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.queries()[name](spark, SF)
    res = con.execute(registry.oracles()[name])
    columns = [d[0] for d in res.description]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert sorted(df.columns) == sorted(columns)
    assert got == sorted(repr(tuple(r)) for r in res.fetchall())
