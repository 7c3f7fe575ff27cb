"""Alarms by state against the batch operators, late rows, and series that fall silent."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import series as B
from millrace.scratch import written
from millrace.streaming import replay as P

SCHEMA = "run long, tag string, ts timestamp, value double"
BEGIN = datetime(2026, 3, 1)


def recorded(spark, columns, minutes=30):
    rows = [(1, tag, i, BEGIN + timedelta(minutes=minutes * i), x) for tag, xs in columns.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "run long, tag string, row_no long, ts timestamp, value double")


def walk(seed, n, day=0.0):
    """A series with spikes, steps and bad samples, and if asked a daily swing."""
    rng, at, out = random.Random(seed), 100.0, []
    for i in range(n):
        at += rng.choice([0.0] * 30 + [25.0, -25.0])
        swing = day * (1 if i % 48 < 24 else -1)
        out.append(None if rng.random() < 0.06 else at + swing + rng.gauss(0, 1) + (60 if rng.random() < 0.02 else 0))
    return out


def alarms_of(flags, readings, least):
    """What the batch operators say: the time of the ``least``-th row of each run of flags."""
    at = B.alarm_runs(flags, least).select("run", "tag", (F.col("first_row") + least - 1).alias("row_no"))
    return sorted((r.tag, r.us) for r in at.join(readings, ["run", "tag", "row_no"]).select("tag", F.unix_micros("ts").alias("us")).collect())


def streamed(spark, readings, slices, band, rule, profile=None):
    stream = P.replay(spark, P.sliced(readings.select("run", "tag", "ts", "value"), slices), SCHEMA)
    return P.drained(P.drift_events(stream, band, rule, profile), "append", "t", spark).collect()


@pytest.mark.parametrize("cyclic", [False, True])
def test_alarms_of_fitted_bands_equal_the_batch_operators(spark, cyclic):
    own = recorded(spark, {"a": walk(1, 500, 30.0), "b": walk(2, 420, 30.0), "flat": [5.0] * 50, "bad": [None] * 40, "short": [1.0]})
    profile = written(B.slot_profile(own), "profile") if cyclic else None
    gaps = B.cyclic_gaps(own, profile) if cyclic else B.drift_gaps(own)
    band = written(B.drift_bands(B.drift_stats(gaps), 1.0 if cyclic else 2.0), "bands")
    want = alarms_of(B.drift_flags(gaps, band, not cyclic), own, 3)
    got = streamed(spark, own, 3, band, P.Rule(median=cyclic, follow_level=not cyclic, bad_breaks=True), profile)
    assert len(want) > 4 and sorted((r.tag, r.ts_us) for r in got) == want
    assert {r.kind for r in got} == {"alarm"} and {r.late for r in got} == {0}


def put(spark, path, rows):
    """A slice of one series: (minute, value) pairs; minute None is a row without a time."""
    data = [(1, "a", None if m is None else BEGIN + timedelta(minutes=m), x) for m, x in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_counted_and_change_nothing_else(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    put(spark, path, [(i, 10.0) for i in range(20)])
    put(spark, path, [(3, 900.0), (19, 900.0), (None, 900.0), (21, 90.0), (20, 90.0), (21, 10.0)])
    put(spark, path, [(22, 90.0), (5, 900.0)])
    got = P.drained(P.drift_events(P.replay(spark, path, SCHEMA), 5.0), "append", "t", spark).collect()
    assert sorted((r.kind, r.n, r.late) for r in got) == [("alarm", 23, 5), ("late", 20, 4), ("late", 22, 1)]


def test_bad_samples_end_a_run_only_if_asked(spark):
    own = recorded(spark, {"a": [10.0] * 20 + [90.0, 90.0, None, 90.0, 90.0]})
    count = lambda breaks: [r.n for r in streamed(spark, own, 4, 5.0, P.Rule(bad_breaks=breaks))]
    assert count(False) == [23] and count(True) == []


def test_a_series_without_a_band_never_flags(spark):
    own = recorded(spark, {"a": [10.0] * 20 + [90.0] * 5, "b": [10.0] * 20 + [90.0] * 5})
    band = spark.createDataFrame([(1, "a", 10.0, 0.0, 5.0)], "run long, tag string, mean double, gap_mean double, half_width double")
    assert [(r.tag, r.n) for r in streamed(spark, own, 2, band, P.Rule())] == [("a", 23)]


def test_a_silent_series_begins_anew(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    put(spark, path, [(i, 10.0) for i in range(20)])
    put(spark, path, [(20 + i, 90.0) for i in range(5)])
    put(spark, path, [(2, 10.0)])
    events = lambda ttl: [(r.kind, r.n) for r in P.drained(P.drift_events(P.replay(spark, path, SCHEMA), 5.0, P.Rule(ttl_ms=ttl)), "append", "t", spark, idle_steps=False).collect()]
    assert sorted(events(3_600_000)) == [("alarm", 23), ("late", 25)]
    assert events(1) == []  # nothing is left of the first slice when the second comes


def test_steps_do_not_grow_with_the_files_of_a_slice(spark, tmp_path):
    path = f"{tmp_path}/many"
    spark.range(1000).repartition(40).write.parquet(path)
    assert P.step_files(spark, path, 4) == 10
    assert P.step_files(spark, path, 4, step_rows=100) == 4
    one = f"{tmp_path}/one"
    spark.range(10).coalesce(1).write.parquet(one)
    assert P.step_files(spark, one, 4) == 1
