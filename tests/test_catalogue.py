"""Each query with SQL against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from lodestone.plans import catalogue
from lodestone.sources import parsers

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_open_references(spark, tmp_path):
    pages = ["<title>a&amp;&amp;b&amp</title><p>&copy;&copy &quo &quot</p>", "<script>a&&b&amp;c&amp</script><a href='?x&copy=1'>&amp;lt;&ampx;</a>", "<p>&nbsp;x&nbsp</p><!-- &amp --><p>&</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES["html_text"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.sql(catalogue.SQL["html_text"]).df())
    assert parsers.parse("a.html", pages[0].encode())[0][2] == "a&&b&\n©© &quo \""
