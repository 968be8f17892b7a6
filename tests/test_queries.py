import os

import duckdb
import pytest

from defectlake.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = sql.sql(SQL[name]).fetchdf()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    sort = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert sort(got).astype(str).equals(sort(want).astype(str))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
