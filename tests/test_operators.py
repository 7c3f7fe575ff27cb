"""Literal fixtures with hand-computed rows, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import sinks
from millrace.functions import text as T
from millrace.operators import graphs as G
from millrace.operators import matching as M
from millrace.operators import records as R
from millrace.operators import scoring as S
from millrace.operators import series as B
from millrace.sources import historian as H
from millrace.sources import records as SR


def readings(spark, values, run=1, tag="a"):
    rows = [(run, tag, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run long, tag string, row_no long, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("row_no") * 180))


def test_constant_and_empty_series_bands(spark):
    both = readings(spark, [5.0, 5.0, None]).unionByName(readings(spark, [None, None], tag="b"))
    got = B.bands(B.band_stats(both), 3).collect()
    assert [(r.tag, r.mean, r.sd, r.fit_good, r.fit_bad, r.constant_in_fit) for r in got] == [("a", 5.0, 0.0, 2, 1, True)]
    flags = B.band_flags(readings(spark, [5.0, 5.1, None]), B.bands(B.band_stats(both), 3)).orderBy("row_no").collect()
    assert [r.flag for r in flags] == [False, True, False]


def test_alarm_runs_need_three_in_a_row(spark):
    flags = readings(spark, [1, 1, 0, 1, 1, 1, 1, 0, 1.0]).withColumn("flag", F.col("value") == 1)
    assert [(r.first_row, r.last_row, r.samples) for r in B.alarm_runs(flags).collect()] == [(3, 6, 4)]


def sequential_gaps(values, fast, slow):
    f = s = 0.0
    n, out = 0, []
    for x in values:
        if x is None:
            out.append(None)
            continue
        n += 1
        f += max(1 / fast, 1 / n) * (x - f)
        out.append(f - s if n > 1 else None)
        s += max(1 / slow, 1 / n) * (x - s)
    return out


@pytest.mark.parametrize("chunk", [3, 17, 4096])
def test_drift_gaps_do_not_depend_on_the_chunk(spark, chunk):
    rng = random.Random(1)
    values = [None if rng.random() < 0.1 else rng.gauss(10, 3) for _ in range(120)]
    got = [r.gap for r in B.drift_gaps(readings(spark, values), 5, 30, chunk).orderBy("row_no").collect()]
    want = sequential_gaps(values, 5, 30)
    assert len(got) == len(want) == 120
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want, strict=True))


def test_median3_passes_the_first_two(spark):
    got = {r.row_no: r.median3 for r in B.median3(readings(spark, [1.0, None, 9.0, 2.0, 3.0])).collect()}
    assert got == {0: 1.0, 1: None, 2: 9.0, 3: 2.0, 4: 3.0}


def boxes(rng, n):
    return [(rng.randint(1, 3), i, rng.choice("ab"), *(lambda x, y: (float(x), float(y), float(x + rng.randint(5, 60)), float(y + rng.randint(5, 60))))(rng.randint(0, 300), rng.randint(0, 300))) for i in range(n)]


def plain_iou(a, b):
    inter = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
    union = (a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter
    return inter / union if union > 0 else 0.0


def test_match_equals_sequential_greedy(spark):
    rng = random.Random(9)
    preds, keys = boxes(rng, 90), boxes(rng, 80)
    schema = "sheet int, id long, class string, x0 double, y0 double, x1 double, y1 double"
    p = spark.createDataFrame(preds, schema).withColumn("tool", F.lit(0))
    got = {(r.pred_id, r.key_id) for r in M.match(p, spark.createDataFrame(keys, schema), ["sheet"], ["tool"], need_class=True, threshold=0.05).collect()}
    pairs = sorted((-plain_iou(a, b), a[1], b[1]) for a in preds for b in keys if a[0] == b[0] and a[2] == b[2] and plain_iou(a, b) >= 0.05)
    used_p, used_k, want = set(), set(), set()
    for _, a, b in pairs:
        if a not in used_p and b not in used_k:
            want.add((a, b))
            used_p.add(a)
            used_k.add(b)
    assert got == want


def test_known_answer_controls(spark):
    counts = spark.createDataFrame([("perfect", 5, 5, 5), ("empty", 0, 0, 5), ("none", 0, 0, 0)], "control string, tp int, predicted int, in_key int")
    got = {r.control: (r.precision, r.recall, r.f1) for r in S.prf(counts).collect()}
    assert got == {"perfect": (1.0, 1.0, 1.0), "empty": (0.0, 0.0, 0.0), "none": (0.0, 0.0, 0.0)}


def test_intervals_by_hand(spark):
    one = S.run_interval(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0)], "k string, v double"), ["k"], "v")
    got = {r.k: r for r in one.collect()}
    assert abs(got["a"].hi - (2 + 4.303 / 3**0.5)) < 1e-9 and got["b"].lo is None and got["b"].sd is None
    arms = spark.createDataFrame([(0, "x", 1.0), (0, "x", 1.0), (0, "y", 3.0), (0, "y", 3.0)], "g int, arm string, v double")
    w = S.welch(arms, ["g"], "arm", "x", "y", "v").collect()[0]
    assert (w["diff"], w.lo, w.hi, w.verdict) == (-2.0, -2.0, -2.0, "b")


def test_caught_splits_ties(spark):
    rows = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 1), (1, 0.5, 0), (1, 0.1, 0), (1, 0.1, 1)], "g int, risk double, wrong int")
    assert abs(S.caught(rows, 0.4, ["g"]).collect()[0].caught - 0.5) < 1e-9  # 1 + half of 1 of 3


def test_allocation_keeps_the_floor(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 89)], "stratum string, size long")
    got = {r.stratum: r["take"] for r in S.allocation(sizes, 20).collect()}
    assert got["a"] == 1 and got["b"] >= 2 and sum(got.values()) == 20


def test_components_hops_and_links(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (7, 7)], "a long, b long")
    nodes = spark.range(1, 9).withColumnRenamed("id", "id")
    assert {r.id: r.root for r in G.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8}
    start = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.hop) for r in G.hops(start, edges, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    blocked = spark.createDataFrame([(2,)], "id long")
    assert {r.id for r in G.hops(start, edges, 3, blocked).collect()} == {1, 2}
    roles = spark.createDataFrame([(1, "scored"), (2, "pass"), (3, "pass"), (4, "scored"), (5, "scored"), (6, "other"), (7, "pass"), (8, "scored")], "id long, role string")
    direct, met = G.asset_links(roles, edges)
    assert direct.count() == 0 and {tuple(r) for r in met.collect()} == {(2, 1), (2, 4)}


def test_renames_refuse_clashes(spark):
    items = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id long, tag string")
    out, clash = R.renamed(items, spark.createDataFrame([("A", "X"), ("B", "C")], "old string, new string"))
    assert {(r.id, r.tag, r.former_tag) for r in out.collect()} == {(1, "X", "A"), (2, "C", "B"), (3, "C", None)}
    assert [tuple(r) for r in clash.collect()] == [("C", "held by another item")]


def test_nested_claims_keep_types_and_places(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": false}, "l": [{"x": 0}, "s"], "n": null}')], "id long, j string")
    got = {(r.name, r.value) for r in R.flattened(rows, "id", "j").collect()}
    assert {("a.b", "false"), ("l[0].x", "0"), ("l[1]", "s")} <= got


def test_spellings(spark):
    t = spark.createDataFrame([(" fic_ 101-a ",), ("ＦＩ１０１",), (None,)], "t string")
    c = F.col("t")
    got = [tuple(r) for r in t.select(T.tag_lenient(c), T.tag_screen(c), T.tag_lenient(T.nfkc(c))).collect()]
    assert got == [("FIC101A", "FIC-101-A", "FIC101A"), ("", "ＦＩ１０１", "FI101"), (None, None, None)]


def test_wide_csv_round_trip_with_bad_samples(spark, tmp_path):
    own = readings(spark, [1.0, None, 3.0]).unionByName(readings(spark, [4.0, 5.0, 6.0], tag="b"))
    sinks.wide_csv(own, ["a", "b"], f"file://{tmp_path}/w")
    got = sorted((r.row_no, r.tag, r.value) for r in H.wide_csv(spark, f"file://{tmp_path}/w/*/*.csv").collect())
    assert got == [(0, "a", 1.0), (0, "b", 4.0), (1, "a", None), (1, "b", 5.0), (2, "a", 3.0), (2, "b", 6.0)]
    (tmp_path / "x.csv").write_text("minutes,T1\n0,1\n1,Bad\n1,nan\n0,inf\n,7\n")
    bad = H.wide_csv(spark, f"file://{tmp_path}/x.csv")
    assert [r.value for r in bad.orderBy("row_no").collect()] == [1.0, None, None, None, 7.0]
    assert {(r.row_no, r.finding) for r in H.order_findings(bad).collect()} == {(2, "time does not rise"), (3, "time does not rise"), (4, "no time")}


def test_archives_and_line_ends_hash_alike(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes(b"x\r\ny")
    (tmp_path / "b.txt").write_bytes(b"x\ny")
    for name, order in (("c.zip", "mn"), ("d.zip", "nm")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n in order:
                z.writestr(n, n * 3)
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in SR.file_digests(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"] == got["b.txt"] and got["c.zip"] == got["d.zip"] != got["a.txt"]


def test_stream_equals_batch(spark):
    from millrace.streaming import replay as P

    own = readings(spark, [10.0] * 20 + [40.0] * 10 + [None] + [10.0] * 5)
    path = P.sliced(own.select("run", "tag", "ts", "value"), 3)
    got = P.drained(P.drift_alarms(P.replay(spark, path, "run long, tag string, ts timestamp, value double"), 5.0), "append", "t", spark).collect()
    gaps = B.drift_gaps(own).orderBy("row_no").collect()
    run, want = 0, []
    for n, r in enumerate(gaps, 1):
        run = run + 1 if r.gap is not None and abs(r.gap) > 5 else 0
        if run == 3:
            want.append(n)
    assert [r.n for r in got] == want


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_files_with_other_column_orders_keep_their_values(spark, tmp_path):
    put(tmp_path / "a.csv", "\ufefft,flow,level\r\n1,10,20\r\n\r\n2,11,21\r\n")
    put(tmp_path / "b.csv", 't,level,"fl""ow, x"\n1,"20",10\n , \n3,nan,"1,5"\n')
    got = {(r.run[-5:], r.row_no, r.idx, r.tag, r.tag_pos, r.value) for r in H.wide_csv(spark, f"file://{tmp_path}/*.csv").collect()}
    assert got == {
        ("a.csv", 0, 1.0, "flow", 0, 10.0), ("a.csv", 0, 1.0, "level", 1, 20.0), ("a.csv", 1, 2.0, "flow", 0, 11.0), ("a.csv", 1, 2.0, "level", 1, 21.0),
        ("b.csv", 0, 1.0, "level", 0, 20.0), ("b.csv", 0, 1.0, 'fl"ow, x', 1, 10.0), ("b.csv", 1, 3.0, "level", 0, None), ("b.csv", 1, 3.0, 'fl"ow, x', 1, None),
    }


def test_what_a_strict_reader_refuses(spark, tmp_path):
    put(tmp_path / "fine.csv", "t,a\n1,2\n2,\n")
    put(tmp_path / "head.csv", "t,a,a,,12\n1,1,1,1,1\n")
    put(tmp_path / "bare.csv", "t,a\n")
    put(tmp_path / "one.csv", "t\n1\n")
    put(tmp_path / "rows.csv", "t,a\n1,2,3\n2\n2,5\nsoon,1\ninf,1\n")
    put(tmp_path / "mixed.csv", "t,a\n2026-10-01T09:40:00Z,1\n2026-10-01 09:41:00,2\n")
    put(tmp_path / "open.csv", 't,a\n1,"x\n2,y"\n')
    got = sorted((r.run.rsplit("/", 1)[1], r.row_no, r.finding) for r in H.wide_findings(spark, f"file://{tmp_path}/*.csv").collect() if not r.run.endswith("open.csv"))
    assert sorted(got, key=str) == sorted([
        ("bare.csv", None, "no data rows"),
        ("head.csv", None, "empty tag name"), ("head.csv", None, "repeated tag name"), ("head.csv", None, "tag name is a number"),
        ("mixed.csv", None, "kinds or zones of time are mixed"),
        ("one.csv", None, "fewer than two columns"),
        ("rows.csv", 0, "cells do not fit the header"), ("rows.csv", 1, "cells do not fit the header"), ("rows.csv", 2, "time does not rise"), ("rows.csv", 3, "no time"), ("rows.csv", 4, "no time"),
    ], key=str)
    opened = {r.finding for r in H.wide_findings(spark, f"file://{tmp_path}/open.csv").collect()}
    assert "line break inside quotes" in opened


def test_rows_are_numbered_across_splits(spark, tmp_path):
    """A file in many splits, with and without blank lines."""
    put(tmp_path / "x.txt", "".join(f"line {i:06d}\n" for i in range(20_000)))
    put(tmp_path / "y.txt", "".join(f"line {i:06d}\n" + "\n" * (i % 7 == 0) for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = H.file_rows(spark, f"file://{tmp_path}/*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 40_000 and all(int(r.line[5:]) == r.position for r in rows)


def test_row_offset_needs_one_fitting_place(spark):
    raw = spark.createDataFrame([(i, v) for i, v in enumerate("aaabacaaad")], "row_no long, v string")
    merged = [("one", 0, "a"), ("one", 1, "b"), ("one", 2, "a"), ("two", 0, "a"), ("two", 1, "a"), ("none", 0, "b"), ("none", 1, "d"), ("lacks", 0, "d"), ("lacks", 1, "z")]
    found = H.row_offset(spark.createDataFrame(merged, "merged string, row_no long, v string"), raw, ["v"])
    assert {(r.merged, r.offset) for r in found.collect()} == {("one", 2)}
    flat = spark.range(50_000).select(F.col("id").alias("row_no"), F.lit("x").alias("v"))
    assert H.row_offset(flat.where("row_no < 100").select(F.lit(1).alias("merged"), "row_no", "v"), flat.withColumn("v", F.when(F.col("row_no") == 70, "y").otherwise(F.col("v"))), ["v"]).count() == 0


def test_long_chains_and_hubs_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)], "a long, b long")
    nodes = edges.selectExpr("a as id").union(edges.selectExpr("b as id")).distinct()
    got = {r.id: r.root for r in G.components(nodes, edges).collect()}
    assert len(got) == 701 and set(got.values()) == {0, 1000} and got[400] == 0 and got[1299] == 1000


def test_owners_are_the_nearest_upstream_units(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4), (4, 5), (5, 1), (7, 8)], "a long, b long")  # with a loop
    units = spark.createDataFrame([(1,), (9,)], "id long")
    assert {(r.id, r.owner, r.hop) for r in G.owners(units, edges).collect()} == {(1, 1, 0), (9, 9, 0), (2, 1, 1), (3, 1, 2), (4, 9, 1), (5, 9, 2)}


@pytest.mark.parametrize("span", [1, 2, 10, 600])
def test_averages_equal_a_walk(span):
    rng = random.Random(span)
    for first in (1, 2, 700):
        x, at, want = [rng.gauss(5, 2) for _ in range(700)], 3.0, []
        for i, v in enumerate(x):
            w = max(1 / span, 1 / (first + i))
            want.append((at, at + w * (v - at)))
            at += w * (v - at)
        import numpy as np

        got = B.averages(np.array(x), first + np.arange(700.0), span, 3.0)
        assert all(abs(b - c) < 1e-9 and abs(a - d) < 1e-9 for (b, a), c, d in zip(want, *got, strict=True))


def test_cyclic_method_finds_a_step_that_the_daily_swing_hides(spark):
    """Six days of half-hours with a swing of 40 and a step of 12 in the last one: the cyclic method flags it, level bands do not."""
    import math

    rows = [(1, "a", i, 100 + 20 * math.sin(i * 2 * math.pi / 48) + ((i * 7919) % 13) / 13 + (12 if i >= 260 else 0)) for i in range(288)]
    own = spark.createDataFrame(rows, "run long, tag string, row_no long, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_006_400) + F.col("row_no") * 1800))
    flags, choice, _ = B.fitted_gaps(own.where("row_no < 260").unionByName(own.where("row_no >= 260")), "cyclic")
    hit = [r.row_no for r in flags.where("flag").collect()]
    assert hit and min(hit) >= 260
    level = B.band_flags(own, B.bands(B.band_stats(own.where("row_no < 144")), 3.0))
    assert level.where("flag").isEmpty()


def test_nested_records_of_any_depth(spark):
    deep = "1"
    for i in range(12):
        deep = '{"k": [' + deep + ', null]}' if i % 2 else "[" + deep + "]"
    rows = spark.createDataFrame([("x", deep), ("y", '{"a": {}, "b": "t"}'), ("z", None)], "owner string, j string")
    got = {(r.owner, r.name.count("k"), r.value) for r in R.flattened(rows, "owner", "j").collect() if r.value is not None}
    assert ("x", 6, "1") in got and ("y", 0, "t") in got


def mapping_case(spark):
    items = spark.createDataFrame(
        [(1, "FT-1", "a", False, False, None), (2, "FT 2", "a", False, False, ("old", "b", "p")), (3, "FT2", "b", False, False, None), (4, "LT-4", "b", True, False, None), (5, "PT-5", "b", False, True, None), (6, "PT-6", "b", False, False, ("old", "b", "q"))],
        "id long, tag string, sheet string, rejected boolean, placeholder boolean, data_point struct<server:string,base_path:string,point:string>",
    )
    rows = [(1, "ft_1", None, "s", "b", "p1"), (2, "FT-2", "", "s", "b", "p2"), (3, "x", " 3 ", "s", "b", "p3"), (4, "LT-4", None, "s", "b", "p4")]
    bad = [(5, None, " ", "s", "b", "p"), (6, "FT-1", None, "s", " ", "p"), (7, "FT-1", "9", "s", "b", "p"), (8, "x", "4", "s", "b", "p"), (9, "zz", "3", "s", "b", "p")]
    table = lambda r: spark.createDataFrame(r, "row long, tag string, asset_id string, server string, base_path string, point string")
    return items, table(rows), table(rows + bad)


def test_mapping_plans_and_refusals(spark):
    items, rows, with_bad = mapping_case(spark)
    plan = R.plan_mapping(rows, items)
    assert {(r.row, r.asset, r.outcome) for r in plan.collect()} == {(1, 1, "mapped"), (2, None, "ambiguous"), (3, 3, "mapped"), (4, None, "not on drawing"), (None, 2, "not in list"), (None, 5, "not in list"), (None, 6, "not in list")}
    done = {r.id: r.data_point and r.data_point.point for r in R.mapped_items(items, rows, plan).collect()}
    assert done == {1: "p1", 2: "p", 3: "p3", 4: None, 5: None, 6: "q"}
    assert not R.mapping_applies(plan, replace_all=True) and R.mapped_items(items, rows, plan, replace_all=True) is items
    refused = R.plan_mapping(with_bad, items)
    assert {(r.row, r.outcome) for r in refused.collect() if r.row and r.row > 4} == {(5, "refused: tag or asset id is needed"), (6, "refused: address is blank"), (7, "refused: unknown or rejected asset id"), (8, "refused: unknown or rejected asset id"), (9, "refused: target given twice")}
    assert R.mapped_items(items, with_bad, refused) is items
    sheet = R.plan_mapping(rows.where("row = 1"), items, ["b"])
    assert {r.outcome for r in sheet.collect() if r.row} == {"refused: outside the sheets"}
    whole = R.plan_mapping(rows.where("row = 3"), items, ["b"])
    assert {r.id: r.data_point and r.data_point.point for r in R.mapped_items(items, rows, whole, ["b"], replace_all=True).collect()} == {1: None, 2: "p", 3: "p3", 4: None, 5: None, 6: None}


def test_relations_and_rules(spark):
    from millrace.operators import rules as Q

    rows = [
        (1, "equipment", "P-1", None, None, "s", "feed pump", None, None),
        (2, "valve", "FV-2", 1, "x", "s", "hot oil valve", None, None),
        (3, "controller", "FIC-3", 1, None, "s", "hot oil control", "FT 4", ["fv2"]),
        (4, "instrument", "FT-4", 1, "x", "s", "flow", None, None),
        (5, "equipment", "E-5", None, None, "s", "bypassed cooler", None, None),
        (6, "instrument", "TT-6", 5, "x", "t", "temperature of water", None, None),
        (7, "instrument", "LT-7", None, "y", "s", "level", None, None),
    ]
    items = spark.createDataFrame(rows, "id long, kind string, tag string, unit long, stream string, sheet string, text string, measurement string, outputs array<string>")
    streams = spark.createDataFrame([("x", 1, 5)], "stream string, src long, dst long")
    links = spark.createDataFrame([(2, 1), (1, 5), (2, 4), (4, 7), (4, 6)], "a long, b long")
    m = Q.Model(items, streams, links, {"oil": "oil", "water": "water"})
    found = lambda anchor, relation, **o: {r.id for r in Q.pairs(m, items.where(F.col("id") == anchor), items, relation, **o).collect()}
    assert found(2, "same_stream") == {4, 6} and found(2, "same_unit") == {1, 3, 4} and found(2, "same_unit_same_medium") == {3}
    assert found(2, "drives") == {3} and found(4, "reads") == {3} and found(4, "drives") == set()
    assert found(2, "linked") == {4, 5, 6} and found(2, "discharge_side") == {4, 6} and found(6, "discharge_side") == set()
    assert found(2, "near", max_hops=1) == {1, 4} and found(2, "near") == {1, 4, 7}  # not through the pump, not to another sheet
    has = lambda relation, select: {r.anchor for r in Q.having(m, items, {"relation": relation, "select": select}).collect()}
    assert has("anywhere", {"tag": "^P-1"}) == {2, 3, 4, 5, 6, 7} and has("other_unit", {"tag": "^TT-6"}) == {1, 2, 3, 4}
    ask = lambda **q: {(r.place, r.anchors, r.first_tag, r.shown) for r in Q.run(m, {"id": "q", **q}).collect()}
    assert ask(anchor={"kind": ["instrument"]}) == {("1", 1, "FT-4", 0), ("5", 1, "TT-6", 0), ("7", 1, "LT-7", 0)}
    assert ask(anchor={"kind": ["instrument"]}, unit_not_text="cooler|pump") == {("7", 1, "LT-7", 0)}
    assert ask(anchor={"kind": ["valve"]}, also_show=[{"select": {}, "relation": "same_stream"}]) == {("1", 1, "FV-2", 2)}
    assert ask(anchor={"kind": ["instrument"]}, group_by="model", min_anchors=4) == set() and ask(anchor={}, needs_model=["boiler"]) == set()


def test_streams_are_repaired_where_one_segment_fits(spark):
    allowed = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (2, "d", "e")], "number int, a string, b string")
    drawn = spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "c", "b"), (3, 1, "b", "z"), (4, 1, "z", "b"), (5, 2, "z", "q"), (6, 9, "a", "b"), (7, 1, "b", "b")], "id int, number int, a string, b string")
    got = {r.id: (r.result, r.fix) for r in R.checked_streams(drawn, allowed).collect()}
    assert got == {1: ("confirmed", None), 2: ("corrected", "reversed"), 3: ("corrected", "to c"), 4: ("corrected", "from a"), 5: ("unresolvable", None), 6: ("unresolvable", None), 7: ("unresolvable", None)}


def test_loops_are_audited_along_signals_and_flags(spark):
    from millrace.operators import audits as A

    loops = spark.createDataFrame([(1, "FIC 1", "FT-1", "FV1"), (2, "FIC-2", "FIC2", "FV-2"), (3, "FIC-3", "FT-3", "FV-3"), (4, "", "", "")], "loop int, controller string, measurement string, output string")
    symbols = spark.createDataFrame([("d", 1, "fic-1", None, None), ("d", 2, "FT1", None, None), ("d", 3, "", "FV-1", None), ("e", 4, None, None, "FIC_1"), ("e", 5, "FV-1", None, None), ("d", 6, "FIC2", None, None), ("d", 7, "FV-2", None, None), ("d", 8, "FT-3", None, None)], "drawing string, id int, text string, signal_to string, signal_from string")
    lines = [("d", 2, 1), ("d", 1, 3), ("e", 5, 4)]
    audit = lambda s: {r.loop: (r.signal_in, r.signal_out, r.status) for r in A.loop_audit(loops, symbols, spark.createDataFrame(s, "drawing string, a int, b int")).collect()}
    assert audit(lines) == {1: (True, True, "drawn"), 2: (True, False, "partly_drawn"), 3: (False, False, "not_drawn"), 4: (False, False, "not_drawn")}
    assert audit(lines[:2] + [("d", 6, 7)]) == {1: (True, False, "partly_drawn"), 2: (True, True, "drawn"), 3: (False, False, "not_drawn"), 4: (False, False, "not_drawn")}


def plain_connectors(rows, sheets):
    number = {s: n for s, n, _ in sheets}
    code = {s: c for s, _, c in sheets}
    listed = {n for n in number.values() if n}
    found = []
    for x in rows:
        for y in rows:
            if x[2] and number[y[1]] == x[2] and x[1] != y[1]:
                way = 0 if number[x[1]] and y[2] == number[x[1]] else 1 if not number[x[1]] and y[2] not in listed and y[3] and y[3] == code[x[1]] else None
                if way is not None:
                    a, b = set(x[4]), set(y[4])
                    found.append((-len(a & b) / len(a | b), way, x[0], y[0]))
    pair = {}
    for _, _, x, y in sorted(found):
        if x not in pair and y not in pair:
            pair[x], pair[y] = y, x
    return pair


def test_connectors_pair_like_a_plain_greedy_choice(spark):
    from millrace.operators import audits as A

    rng = random.Random(3)
    sheets = [(s, None if s % 4 == 3 else f"D{s}", f"S{s}") for s in range(8)]
    rows = [(i, rng.randrange(8), rng.choice([None, *[f"D{s}" for s in range(9)]]), f"S{rng.randrange(8)}", rng.sample("abcdef", 2)) for i in range(160)]
    got = A.pair_connectors(spark.createDataFrame(rows, "id int, sheet int, ref string, code string, words array<string>"), spark.createDataFrame(sheets, "sheet int, number string, system_code string")).collect()
    assert {r.id: r.pair for r in got if r.pair is not None} == plain_connectors(rows, sheets)
    assert len(got) == 160 and {r.method for r in got if r.pair is not None} == {"reciprocal", "one way and system code"}
    for r in got:
        _, sheet, ref, *_ = rows[r.id]
        want = "paired" if r.pair is not None else "no drawing" if not ref else "own sheet" if ref == sheets[sheet][1] else "not in this" if ref not in {n for _, n, _ in sheets} else "no connector"
        assert want in r.status


def test_parents_by_link_chain_and_gap(spark):
    from millrace.operators import audits as A

    box = lambda x: (float(x), 0.0, float(x + 2), 2.0)
    rows = [(1, "s", "instrument", *box(0)), (2, "s", "equipment", *box(50)), (3, "s", "equipment", *box(4)), (4, "s", "instrument", *box(100)), (5, "s", "instrument", *box(110)), (6, "s", "line_item", *box(300)), (7, "s", "instrument", *box(297)), (8, "t", "instrument", *box(0)), (9, "s", "equipment", *box(20))]
    items = spark.createDataFrame(rows, "id int, sheet string, role string, x0 double, y0 double, x1 double, y1 double")
    links = spark.createDataFrame([(1, 2), (9, 1), (4, 5), (5, 6), (5, 2)], "a int, b int")
    got = {r.id: (r.parent, r.method, r.nearest, r.agrees) for r in A.parents(items, links).collect()}
    assert got == {1: (9, "linked", 3, False), 4: (2, "via instruments", 2, True), 5: (2, "linked", 2, True), 7: (6, "nearest", 6, True), 8: (None, "none", None, False)}
