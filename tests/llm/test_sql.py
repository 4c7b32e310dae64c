"""The queries of this subpackage that have SQL give its rows in DuckDB, on the smallest tables."""

import duckdb
import pytest

from assayer.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    df = queries.queries()[name](spark, D)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(got.fetchall(), key=repr)
