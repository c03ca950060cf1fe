import duckdb
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equal(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
