"""A query of the subpackage against its SQL in DuckDB, over whole tables."""

import duckdb

from millrace.llm import registry
from tests.test_queries_against_sql import TABLES, rows


def same_as_sql(spark, name, sf="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = registry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got and got == rows(columns, cur.fetchall())
