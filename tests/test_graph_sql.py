"""the SQL of the graph bundle numbers edges beyond 99,999 as the query does."""

import duckdb

from millrace.plans import registry
from tests.test_queries_against_sql import rows


def test_edge_numbers_beyond_five_digits(spark, tmp_path):
    con = duckdb.connect()
    for name, sql in {
        "region": "SELECT 0 AS r_regionkey, 'R' AS r_name",
        "nation": "SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey",
        "supplier": "SELECT i::BIGINT AS s_suppkey, 'S' || i AS s_name, 0 AS s_nationkey FROM range(3) t(i)",
        "part": "SELECT i::BIGINT AS p_partkey, 'P' || i AS p_name, CASE WHEN i < 99990 THEN 1 ELSE 2 END AS p_size FROM range(100050) t(i)",
        "orders": "SELECT i::BIGINT AS o_orderkey, i::BIGINT AS o_custkey, 'O' AS o_orderstatus, '1' AS o_orderpriority, TIMESTAMP '2024-01-01' AS o_orderdate FROM range(5) t(i)",
    }.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    df = registry.queries()["k01_graph_bundle"](spark, str(tmp_path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(registry.oracle_sql()["k01_graph_bundle"])
    assert got == rows([c[0] for c in cur.description], cur.fetchall())
    follows = next(r for r in got if "edges" in r and "follows" in r)
    assert "E100001" in follows
