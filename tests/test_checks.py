"""Literal fixtures for the comparisons and classifications."""

from pyspark.sql import functions as F

from millrace.operators import checks as C


def test_states_with_error_bounds(spark):
    rows = [(5.0, "below"), (9.5, "below"), (11.0, "below"), (None, "above"), (11.5, "above"), (9.0, "above"), (10.5, "above")]
    t = spark.createDataFrame(rows, "v double, side string")
    got = [r.s for r in t.select(C.three_state(F.col("v"), F.lit(1.0), F.lit(10.0), F.col("side")).alias("s")).collect()]
    assert got == ["met", "uncertain", "clear", "no reading", "met", "clear", "uncertain"]


def test_first_rule_and_source(spark):
    t = spark.createDataFrame([("a", None, "z"), (None, "b", "z"), (None, None, "z")], "x string, y string, z string")
    got = t.select(C.first_source([("sx", F.col("x")), ("sy", F.col("y"))]).alias("s"), C.first_rule([("one", F.col("x").isNotNull()), ("two", F.col("y").isNotNull())], None).alias("r")).collect()
    assert [(r.s and tuple(r.s), r.r) for r in got] == [(("a", "sx"), "one"), (("b", "sy"), "two"), (None, None)]


def test_model_and_multiset_differences(spark):
    ours = spark.createDataFrame([("a", "pump", 1), ("b", "pump", 1), ("c", "tank", None), ("d", "tank", 2)], "tag string, kind string, unit int")
    theirs = spark.createDataFrame([("a", "pump", 1), ("b", "tank", 1), ("c", "tank", 3), ("e", "tank", 2)], "tag string, kind string, unit int")
    assert {tuple(r) for r in C.model_diff(ours, theirs, "tag", "kind", ["unit"]).collect()} == {("a", "ok"), ("b", "wrong role"), ("c", "fields differ"), ("d", "missing"), ("e", "extra")}
    drawn = spark.createDataFrame([(1, "v"), (1, "v"), (2, "p")], "line int, kind string")
    modelled = spark.createDataFrame([(1, "v"), (2, "p"), (3, "q")], "line int, kind string")
    assert {tuple(r) for r in C.multiset_diff(drawn, modelled, "line", "kind").collect()} == {(1, "v", 2, 1), (3, "q", 0, 1)}


def test_claims_names_and_networks(spark):
    claims = spark.createDataFrame([(1, "size", "3"), (1, "hue", "x"), (2, "size", None)], "owner int, name string, claimed string")
    fields = spark.createDataFrame([(1, "size", "3"), (2, "size", "4")], "owner int, name string, held string")
    assert {(r.owner, r.name, r.result) for r in C.claim_check(claims, fields).collect()} == {(1, "size", "equal"), (1, "hue", "no field"), (2, "size", "differs")}
    names = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["d"])], "id int, words array<string>")
    sources = spark.createDataFrame([(1, ["b"]), (2, ["x"])], "id int, words array<string>")
    assert {(r.id, r.result) for r in C.name_check(names, sources).collect()} == {(1, "confirmed"), (2, "corrected"), (3, "unverified")}
    members = spark.createDataFrame([(1, "s", 1), (1, "s", 2), (1, "s", 2), (2, "s", 1), (2, "s", 3), (3, "s", 1), (3, "s", 3), (4, "t", 1), (4, "s", 3)], "network int, sheet string, id int")
    assert {tuple(r) for r in C.shared_networks(members).collect()} == {(1, 2, 1)}


def test_pairs_records_and_identities(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "a int, b int")
    got = C.pair_changes(pairs((1, 2), (3, 4)), pairs((2, 1), (5, 6), (6, 5), (7, 8)), pairs((8, 7)))
    assert {tuple(r) for r in got.collect()} == {(3, 4, "removed", False), (5, 6, "added", False), (7, 8, "added", True)}
    made = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, None)], "k string, n int, t string")
    kept = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("d", 3, None)], "k string, n int, t string")
    assert {tuple(r) for r in C.regenerated(made, kept, "k").collect()} == {("a", "MATCH"), ("b", "DIFF"), ("c", "GAP"), ("d", "MISSING")}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert {tuple(r) for r in C.identity_sets(ids(1, 2, 2), ids(2, 3, 3)).collect()} == {(1, "missing"), (3, "extra")}


def test_audits_of_tags_numbers_and_sheets(spark):
    loops = spark.createDataFrame([(1, "fic 1", "TI-1"), (2, "FIC-2", "TI-9"), (3, "x", "y")], "loop int, controller string, measurement string")
    tags = spark.createDataFrame([("FIC_1",), ("ti 1",), ("FIC2",)], "tag string")
    assert {(r.loop, r.status) for r in C.tags_present(loops, tags, ["controller", "measurement"]).collect()} == {(1, "tags_present"), (2, "partly"), (3, "not found")}
    members = spark.createDataFrame([(1, "10"), (1, "10"), (2, "10"), (2, "11")], "loop int, number string")
    assert {(r.loop, r.tags, r.one_number) for r in C.numbering(members).collect()} == {(1, 2, True), (2, 2, False)}
    sheets = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")], "sheet int, system string")
    assert {tuple(r) for r in C.sheet_identity(sheets).collect()} == {(1, "a", 2), (2, "unknown", 1)}


def test_rollups_of_empty_tables(spark):
    flows = spark.createDataFrame([("p", True, 4.0), ("p", False, 3.0), ("q", False, 2.0)], "unit string, outlet boolean, quantity double")
    got = {r.unit: r.imbalance for r in C.imbalance(flows, ["unit"]).collect()}
    assert got["p"] == 0.25 and got["q"] > 1e8
    assert C.imbalance(flows.limit(0), ["unit"]).count() == 0
    staged = spark.createDataFrame([("a", "x", "t"), ("a", "x", "t"), ("b", "y", "t")], "parent string, name string, type string")
    known = spark.createDataFrame([("a",)], "parent string")
    assert {tuple(r) for r in C.staging_findings(staged, known).collect()} == {("duplicate", "a", 2), ("orphan", "b", 1)}
    items = spark.createDataFrame([(1, "ft-1"), (2, "FT-1"), (3, "x")], "id int, tag string")
    assert {r.id for r in C.shared_tags(items).collect()} == {1, 2}
    events = spark.createDataFrame([("u", 0, "go"), ("u", 60, "x"), ("u", 6000, "go"), ("u", 12000, "x"), ("v", 0, "go")], "who string, s long, kind string").withColumn("ts", F.timestamp_seconds("s"))
    assert [tuple(r) for r in C.active_spans(events, "who", F.col("kind") == "go", ["ts"], 30).collect()] == [("u", 31.0, 2)]


def test_means_of_setpoints_do_not_follow_the_order_of_rows(spark, tmp_path):
    """the same values in another order gave another mean, so copies of a series differed in their last digits."""
    from millrace.plans import registry

    rows = [(1, 0.1, 9), (1, 0.2, 2), (1, 0.3, 3), (2, 0.3, 4), (2, 0.2, 5), (2, 0.1, 10), (3, 1e290, 6), (3, 1e-9, 7), (4, 5.0, 8), (4, float("inf"), 1)]
    spark.createDataFrame(rows, "user_id long, value double, event_id long").selectExpr("*", "'view' as event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.off for r in registry.queries()["a29_setpoints"](spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == abs(0.6 / 3 - 0.1) / 0.1 and got[3] == 5e289 / 1e-9 and got[4] == float("inf")
