"""Rows of a series stay together where a join with a table that proves small feeds a scan in chunks."""

import os

import duckdb
import pytest

from millrace.plans import registry
from millrace.scratch import MEASURED, STATIC, joins_as_given

SMALL = {STATIC: "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_tasks(spark, tmp_path):
    """A session that learns at run time which side of a join is small (under ``measured``), with events of ``sf`` dealt over files."""
    joins_as_given(spark)
    before = {k: spark.conf.get(k, None) for k in (*SMALL, MEASURED)}

    def dealt(sf, measured):
        for k, v in (SMALL | {MEASURED: measured}).items():
            spark.conf.set(k, v)
        spark.read.parquet(f"/root/testdata/{sf}/events.parquet").repartition(8, "event_id").write.parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    yield dealt
    joins_as_given(spark)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def differing(spark, folder, name):
    """Rows of query and SQL that the other one lacks, floats to the last bit."""
    df = registry.queries()[name](spark, folder)
    got = set(map(str, (tuple(r) for r in df.collect())))
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{os.path.join(folder, 'events.parquet', '*.parquet')}')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return got ^ set(map(str, want))


@pytest.mark.parametrize("name, sf, measured", [
    ("a23_drift_bands", "sf0.001", "4k"),
    ("a24_drift_choice", "sf0.01", "16k"),
    ("a24_drift_k_table", "sf0.001", "4k"),
    ("t02_fitted_alarms", "sf0.01", "16k"),
    ("w01_drift_gaps", "sf0.001", "4k"),
    ("w03_level_bands", "sf0.001", "4k"),
])
def test_series_are_whole_in_any_number_of_tasks(spark, many_tasks, name, sf, measured):
    """The shuffle before the chunks was dropped and the join's read by its map tasks, so averages began anew in each."""
    assert not differing(spark, many_tasks(sf, measured), name)


def test_gaps_are_rounded_as_the_sql_rounds(spark, tmp_path):
    """means of 32 and 64 values end in half a millionth, and were rounded by the digits they print."""
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id div 15 in (12, 13, 60, 62)").write.parquet(str(tmp_path / "events.parquet"))
    assert not differing(spark, str(tmp_path), "w01_drift_gaps")
