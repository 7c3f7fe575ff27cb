from millrace.operators import rules as Q


def test_rollup_of_three_sites(spark):
    screens = spark.createDataFrame([("a", "q1", "fired"), ("a", "q2", "quiet"), ("b", "q1", "quiet"), ("b", "q2", "not checked"), ("c", "q2", "fired")], "site string, question string, status string")
    findings = spark.createDataFrame([("a", "q1", 1), ("a", "q1", 2), ("a", "q1", 2), ("c", "q2", 1)], "site string, question string, finding long")
    got = {r.question: r for r in Q.site_rollup(screens, findings).collect()}
    assert (got["q1"].fired, got["q1"].findings, got["q1"].fired_at, got["q1"].quiet_at, got["q1"].not_run_at, got["q1"].place) == (1, 2, ["a"], ["b"], ["c"], 1)
    assert (got["q2"].fired_at, got["q2"].quiet_at, got["q2"].not_checked_at, got["q2"].not_run_at, got["q2"].place) == (["c"], ["a"], ["b"], [], 2)
    assert Q.site_rollup(screens.limit(0), findings.limit(0)).count() == 0


def test_places_of_all_findings_come_once(spark):
    rows = [("a", "q", f, "flow", p) for f in (1, 2) for p in ("unit", f"line {f}")] + [("a", "q", 3, "heat", "unit"), ("b", "q", 1, "flow", "unit"), ("b", "q", 2, "flow", None)]
    got = {tuple(r) for r in Q.merged_requests(spark.createDataFrame(rows, "site string, question string, finding long, item string, place string")).collect()}
    assert got == {("q", "flow", "a", "unit", None), ("q", "flow", "a", "line 1", 1), ("q", "flow", "a", "line 2", 2), ("q", "heat", "a", "unit", None), ("q", "flow", "b", "unit", 1)}
