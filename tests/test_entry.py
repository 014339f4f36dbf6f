import duckdb

import __spark_entry__ as E
from conftest import SF001
from docspark.plans.fixtures import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["query_id", "context"]
    assert all(r.context.startswith("[Document 1]") for r in rows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_oracles_run_in_duckdb_at_sf0001(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    q = E.queries()
    for name, sql in E.oracle_sql().items():
        o = con.sql(sql)
        cols = o.columns
        n = len(o.fetchall())
        df = q[name](spark, SF001)
        assert sorted(df.columns) == sorted(cols), name
        assert df.count() == n, name
