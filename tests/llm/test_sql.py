"""Queries of the operators against their SQL, at the smallest scale."""

import duckdb
import pytest

from strataform.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, FOLDER).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.astype(object).values.tolist())) == sorted(map(repr, want.astype(object).values.tolist()))
