"""The corpus queries that SQL can express, against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from linework.llm import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cursor = con.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    df = registry.QUERIES[name](spark, DIR)
    assert set(names) <= set(df.columns)
    assert rows(names, df.select(names).collect()) == rows(names, cursor.fetchall())
