"""Chunked scans give what plain loops over whole series give, whatever the chunks."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from millrace.operators import scans
from millrace.operators import series as S

START = 1_700_000_000


def table(spark, rows):
    return spark.createDataFrame(rows, "run long, tag string, row_no long, value double, state string, flag boolean, at_s long").withColumn("ts", F.timestamp_seconds("at_s"))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(8), []
    for run, tag, n in ((1, "a", 200), (1, "b", 41), (2, "a", 1), (2, None, 30), (3, "gap", 90)):
        at = START
        for i in range(n):
            if tag == "gap" and 5 < i < 80:
                continue  # empty chunks
            at += rng.choice([0, 1, 7, 600, -3])
            out.append((run, tag, i, rng.choice([None, 1.0, 2.0, 5.5, 9.0]), rng.choice([None, "x", "x", "y"]), rng.random() < 0.6, at))
    return out


def by_series(rows):
    order = lambda r: (r[0], str(r[1]))
    return {(k[0], None if k[1] == "None" else k[1]): sorted(g, key=lambda r: r[2]) for k, g in groupby(sorted(rows, key=order), key=order)}


@pytest.mark.parametrize("chunk", [3, 17, 4096])
def test_medians_runs_spells_and_order(spark, rows, chunk):
    df, plain = table(spark, rows), by_series(rows)
    medians, alarms, spells, late, rises = {}, set(), set(), set(), {}
    for (run, tag), own in plain.items():
        good = [r for r in own if r[3] is not None]
        for i, r in enumerate(good):
            medians[run, tag, r[2]] = sorted(x[3] for x in good[i - 2 : i + 1])[1] if i > 1 else r[3]
        medians |= {(run, tag, r[2]): None for r in own if r[3] is None}
        flagged = [r[2] for r in own if r[5]]
        for _, g in groupby(enumerate(flagged), key=lambda x: x[1] - x[0]):
            found = [x for _, x in g]
            if len(found) >= 3:
                alarms.add((run, tag, found[0], found[-1], len(found)))
        for state, g in groupby([r for r in own if r[4] is not None], key=lambda r: r[4]):
            found = list(g)
            spells.add((run, tag, state, found[0][2], found[-1][2], len(found)))
        late |= {(run, tag, y[2]) for x, y in zip(own, own[1:], strict=False) if y[6] <= x[6]}
        rises[run, tag] = min((y[2] for x, y in zip(own, own[1:], strict=False) if y[5] and not x[5] and y[2] > 4), default=None)
    assert {(r.run, r.tag, r.row_no): r.median3 for r in S.median3(df, chunk).collect()} == medians
    assert {(r.run, r.tag, r.first_row, r.last_row, r.samples) for r in S.alarm_runs(df, chunk=chunk).collect()} == alarms
    assert {(r.run, r.tag, r.state, r.first_row, r.last_row, r.samples) for r in S.states(df, "state", chunk).collect()} == spells
    assert {(r.run, r.tag, r.row_no) for r in S.out_of_order(df, chunk).collect()} == late
    assert {(r.run, r.tag): r.onset_row for r in S.onsets(df, 4, chunk).collect()} == rises


@pytest.mark.parametrize("spell", [1_000_000, 60_000_000, S.SPELL])
def test_nearest_readings(spark, rows, spell):
    df = table(spark, rows)
    asked = [(run, tag, START + s) for run, tag in {(r[0], r[1]) for r in rows if r[1]} for s in (-50, 0, 3, 5000, 10**6)]
    moments = spark.createDataFrame(asked, "run long, tag string, at_s long").select("run", "tag", F.timestamp_seconds("at_s").alias("at"))
    got = {(r.run, r.tag, int(r.at.timestamp())): r.ts and int(r.ts.timestamp()) for r in S.nearest(df, moments, spell).collect()}
    for run, tag, at in asked:
        good = [r[6] for r in rows if (r[0], r[1]) == (run, tag) and r[3] is not None]
        assert got[run, tag, at] == min(good, key=lambda t: (abs(t - at), t), default=None)


def test_numbers_by_time_and_by_number(spark, rows, monkeypatch):
    monkeypatch.setattr(scans, "SPELL", 5_000_000)
    monkeypatch.setattr(scans, "CHUNK", 7)
    df = table(spark, rows).withColumn("id", F.col("row_no") * 3)
    for by in (["ts", "id"], ["id"]):
        got = {(r.run, r.tag, r.id): r.row_no for r in S.numbered(df.drop("row_no"), *by).collect()}
        for (run, tag), own in by_series(rows).items():
            order = sorted(own, key=lambda r: ((r[6], r[2]) if by[0] == "ts" else r[2]))
            assert [got[run, tag, r[2] * 3] for r in order] == list(range(len(own)))


def test_neighbours_over_short_chunks(spark):
    df = spark.createDataFrame([(1, "a", i) for i in (0, 1, 4, 9, 10, 11)], "run long, tag string, row_no long")
    near = scans.with_neighbours(df, S.SERIES, ["row_no"], scans.by_rows(chunk=2), 3, 2).collect()
    held = {}
    for r in near:
        held.setdefault(r._chunk, []).append((r.row_no, r._own))
    assert {k: sorted(v) for k, v in held.items()}[4] == [(0, False), (1, False), (4, False), (9, True), (10, False), (11, False)]
    assert sum(r._own for r in near) == 6


def test_statements(spark):
    values = [(0, 5.0, "low"), (1, 20.0, "ok"), (2, None, None), (3, 30.0, "ok"), (4, 24.0, "ok"), (5, 4.0, "low"), (6, 50.0, "ok"), (7, 49.9, "ok"), (8, 3.0, "low")]
    df = spark.createDataFrame([(1, "t", i, v, s, True, START + 60 * i) for i, v, s in values], "run long, tag string, row_no long, value double, state string, flag boolean, at_s long").withColumn("ts", F.timestamp_seconds("at_s"))
    at = lambda i: START + 60 * i
    asked = [
        ("leaves", "t", "leave", "low", None, at(1), 0.5, None),
        ("leaves later", "t", "leave", "low", at(1), at(9), 1.0, None),
        ("enters", "t", "enter", "low", at(1), at(4), 1.0, None),
        ("peak", "t", "peak", None, None, None, None, 5.0),
        ("small peak", "t", "peak", None, at(5), None, None, 0.05),
        ("no peak", "t", "peak", None, at(6), None, None, 0.05),
        ("never", "t", "never", "high", None, None, None, None),
        ("never low", "t", "never", "low", None, None, None, None),
        ("other", "u", "enter", "low", None, None, None, None),
    ]
    s = spark.createDataFrame(asked, "statement string, tag string, test string, state string, after long, expect long, tolerance_min double, drop double")
    s = s.withColumn("after", F.timestamp_seconds("after")).withColumn("expect", F.timestamp_seconds("expect"))
    for chunk in (2, 4096):
        got = {r.statement: (r.got_ts and (int(r.got_ts.timestamp()) - START) // 60, r.value, r.minutes_off, r.ok) for r in S.statement_checks(df, s, chunk).collect()}
        assert got == {
            "leaves": (1, None, 0.0, True), "leaves later": (6, None, -3.0, False), "enters": (5, None, 1.0, True), "peak": (3, 30.0, None, True),
            "small peak": (6, 50.0, None, True), "no peak": (None, None, None, False), "never": (None, 50.0, None, True), "never low": (0, 50.0, None, False),
        }


def test_chunks_are_worked_out_as_arrays_and_not_as_groups(spark):
    """Short series share Arrow batches; keys cut across batches and null keys stay whole."""
    import pyarrow as pa

    from millrace.operators import scans, series

    rows = spark.range(5000).selectExpr("if(id % 7 = 0, null, id % 7) as run", "concat('t', id % 3) as tag", "id as row_no", "cast(id as double) as value")

    def total(t):
        assert t["row_no"].to_pylist() == sorted(t["row_no"].to_pylist())
        return pa.RecordBatch.from_pydict({"run": t["run"].combine_chunks().slice(0, 1), "tag": t["tag"].combine_chunks().slice(0, 1), "n": pa.array([len(t)])})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = scans.by_chunks(rows if size != "1" else rows.limit(200), ["run", "tag"], "row_no", total, "run long, tag string, n long")
            want = (rows if size != "1" else rows.limit(200)).groupBy("run", "tag").count()
            assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, [tuple(r) for r in want.collect()]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = series.drift_gaps(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("FlatMapGroupsInPandas") == 1


def test_cells_of_a_matrix_stay_where_they_were_read(spark, tmp_path):
    """all cells of a file were shuffled to one task to meet its number of rows, and lines were sorted to be counted."""
    from millrace.sources import historian as H

    for name, rows in (("a", 3), ("b", 52)):
        (tmp_path / f"{name}.txt").write_text("\n\n".join(f" {r}.5   {r}  x" for r in range(rows)) + "\n")
    got = H.matrix(spark, str(tmp_path / "*.txt"))
    found = {(r.run[-5:], r.row_no, r.channel): r.value for r in got.collect()}
    assert len(found) == 165 and found["a.txt", 2, 0] == 2.5 and found["b.txt", 0, 51] == 51.5 and found["b.txt", 2, 9] is None
    plan = got.groupBy("channel").count()._jdf.queryExecution().executedPlan().toString()
    assert all("block#" in x.split(")")[0] for x in plan.split("hashpartitioning(run#")[1:])
    _, starts = H._lines(spark, str(tmp_path / "*.txt"))
    assert "head" not in starts.columns


def test_loop_lists_stay_splittable(spark, tmp_path):
    """a loop list was read whole by one task; lines keep their numbers across splits."""
    from millrace.sources import records as R

    rows = [f"FIC-{i % 40},{'' if i % 9 == 4 else f'FT-{i}'},{'FIC 3' if i == 3 else f'FV-{i}'},x" for i in range(200)]
    lines = ["", "# a list", "controller,measurement,output,description", "# note", *rows[:50], "", "  # more", *rows[50:]]
    (tmp_path / "one.txt").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "two.txt").write_text("controller,measurement,output,description\nFIC-1,FT-1,FV-1,y\nFIC-2,FT-2,FIC 2,\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 600)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        good, refused = R.control_loops(spark, str(tmp_path / "*.txt"))
        assert spark.read.text(str(tmp_path / "one.txt")).rdd.getNumPartitions() > 3
        got = {(r.file[-7:-4], r.line): (r.controller, r.refusal) for r in refused.collect()}
        kept = [(r.file[-7:-4], r.line, r.controller) for r in good.collect()]
        used = good.inputFiles()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert kept == [("two", 2, "FIC-1")] and got["two", 3] == ("FIC-2", "output is its controller")
    want = {("one", n): (t.split(",")[0], "empty field" if ",," in t else "repeated controller") for n, t in enumerate(lines, 1) if t.startswith("FIC")}
    assert {k: v for k, v in got.items() if k[0] == "one"} == want
    assert any("millrace-splits" in f for f in used)
