"""Every query with SQL against DuckDB on the driver's smallest tables."""

import os

import duckdb
import pytest

from trellis.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    want = duck.execute(SQL[name]).df()
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(str).replace({"<NA>": "None", "nan": "None", "NaN": "None"}).values.tolist()))
    got = got.toPandas()
    for c in got.columns:
        if str(want[c].dtype) == "Int64":
            got[c] = got[c].astype("Int64")
        if str(want[c].dtype).startswith("float") and want[c].isna().any() and (want[c].dropna() % 1 == 0).all():
            want[c], got[c] = want[c].astype("Int64"), got[c].astype("Int64")
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_lineage_walks_to_the_end(spark, duck):
    got = {r.distance: r.n for r in QUERIES["lineage"](spark, DIR).collect()}
    assert sum(got.values()) == duck.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert max(got) == duck.execute("SELECT max(c) - 1 FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)").fetchone()[0] > 3
