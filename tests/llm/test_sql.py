"""Each corpus query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

from lodestone.llm import queries
from tests.test_catalogue import SMALL, TABLES, rows


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
