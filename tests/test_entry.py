import duckdb

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["facet", "value", "count"] and len(rows) > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_flagship_matches_oracle_at_smoke_scale(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SMOKE}/events.parquet')")
    want = sorted(con.execute(E.oracle_sql()["facet_counts_all"]).fetchall())
    got = sorted(tuple(r) for r in E.queries()["facet_counts_all"](spark, SMOKE).collect())
    assert got == want
