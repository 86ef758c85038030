import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    from pointloom.plans import queries as clustering

    for name in clustering.queries():
        got, want = queries[name](spark, DATA).toPandas(), con.sql(sql[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns, name
        rows = [sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).values.tolist())) for f in (got, want)]
        assert rows[0] == rows[1], name
