"""Queries of training-text operators that SQL can express, against DuckDB on the same files."""

import duckdb
import pytest

from arealis.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("data", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, name, data):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{data}/{t}.parquet')")
    got = queries.QUERIES[name](spark, f"/root/testdata/{data}").toPandas()
    key = ["doc_id"] if "doc_id" in got else ["part", "filter_order", "step"]
    got = got.sort_values(key).reset_index(drop=True)
    want = con.sql(queries.SQL[name]).df().sort_values(key).reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in want.columns:
        assert (got[c].astype(want[c].dtype) == want[c]).all(), c
