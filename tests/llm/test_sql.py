"""Queries of the text operators against their SQL on a small table."""

import duckdb
import pytest

from epochal.llm import queries

from .common import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()), key=repr)
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
