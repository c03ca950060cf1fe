"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    return con


def _tidy(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda v: "inf" if isinstance(v, float) and math.isinf(v) else repr(float(v)) if isinstance(v, float) else repr(v)
    return sorted(tuple(key(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_equal(spark, name):
    sf = os.environ.get("ORACLE_SF", "sf0.001")
    df = registry.QUERIES[name](spark, f"/root/testdata/{sf}")
    got = [tuple(r) for r in df.collect()]
    if name in registry.NO_SQL:
        return
    cur = _con(sf).execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    a, b = _tidy(got, df.columns), _tidy(want, names)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
