from pyspark.sql import functions as F

from millrace.llm import mixing


def level(sizes, weights, most):
    total, targets, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    spare = float(total)
    while spare > 1e-9 and open_:
        w, spare_now, spare = sum(weights[i] for i in open_), spare, 0.0
        for i in list(open_):
            targets[i] += spare_now * weights[i] / w
        for i in list(open_):
            if targets[i] >= most * sizes[i]:
                spare += targets[i] - most * sizes[i]
                targets[i] = float(most * sizes[i])
                open_.discard(i)
    return targets


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i % 7), s) for s, n in (("a", 5), ("b", 40), ("c", 300), (None, 60)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as bucket")
    got = mixing.mix(docs, bucket_rows=50).collect()
    assert len(got) == len(rows)
    sizes = [sum(i % 7 for i in range(n)) for n in (5, 40, 300, 60)]
    want = dict(zip(("a", "b", "c", None), level(sizes, [5, 2, 1, 5], 3), strict=True))
    for s, target in want.items():
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - target) < 1e-6 * max(1, target)
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0) for r in own)
        passes = [p for r in own for p in r.passes]
        assert sum(p.words for p in passes) == sum(r.taken for r in own) and all(p.words <= 6 for p in passes)
    at = [r.position for r in got if r.position is not None]
    goals = sum(int(t) for t in want.values())
    assert at == sorted(at) and 0 <= at[0] and at[-1] < goals + 8


def inverted(goals, row, share, phases=mixing.PHASES):
    """By stepping through training in small parts of a phase."""
    steps, met, demand = 30_000, 0.0, 0.0
    own = phases[row % 3]
    for t in range(steps):
        k = t * 3 // steps
        part = 3 / steps
        if met >= share:
            break
        met += own[k] / sum(own) * part
        demand += sum(g * phases[i % 3][k] / sum(phases[i % 3]) * part for i, g in enumerate(goals))
    return demand


def test_positions_are_the_streams_demand_when_the_source_reaches_its_share(spark):
    from pyspark.sql import functions as F

    goals = [600, 900, 300, 1200]
    plan = spark.createDataFrame(list(enumerate(goals)), "source_no long, goal long")
    demand = mixing.stream_demand(plan, mixing.PHASES)
    assert demand.first().demand[0] == 0 and demand.first().demand[3] == sum(goals)
    for no in range(4):
        for share in (0.0, 0.2, 0.5, 0.7, 0.95):
            got = demand.select(mixing.position_of(F.lit(share), F.lit(no), F.col("demand"), mixing.PHASES).alias("x")).first().x
            assert abs(got - inverted(goals, no, share)) < 3


def test_the_stream_has_no_gaps_and_early_phases_hold_the_early_sources(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs).collect()
    passes = sorted((p.position, p.words, r.source) for r in mixed for p in r.passes)
    total = sum(p[1] for p in passes)
    seen, share = 0, {"a": [0, 0], "c": [0, 0]}
    for at, n, source in passes:
        assert abs(at - seen) < 0.02 * total  # the words before a position are about as many as it says
        seen += n
        if source in share:
            share[source][at > total / 2] += n
    assert share["a"][0] > share["a"][1] and share["c"][0] < share["c"][1]


def test_many_sources_and_ties(spark):
    """Each document a source of its own, sizes all equal."""
    docs = spark.createDataFrame([(i, "x y", f"s{i:04d}") for i in range(400)], "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.mix(docs).collect()}
    want = level([2] * 400, [(5, 2, 1)[i % 3] for i in range(400)], 3)
    assert all(abs(got[f"s{i:04d}"].target - t) < 1e-9 for i, t in enumerate(want))


def test_nulls_empty_and_reruns(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, None, None), (None, "", "a")], schema)).collect()
    assert [(r.size, r.taken, r.position) for r in none] == [(0, 0, None)] * 2
    docs = spark.createDataFrame([(i % 50, "x y z", f"s{i % 3}") for i in range(200)], schema)
    key = lambda rows: sorted((r.doc_id, r.taken, r.position or -1) for r in rows)
    assert key(mixing.mix(docs).collect()) == key(mixing.mix(docs.repartition(5)).collect())


def test_stream_has_a_row_for_each_pass_in_order(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (None, "c", 9), (3, "d", 5)], "doc_id long, text string, passes int").withColumn("one", F.lit(1)).withColumn("Key", F.lit(2))
    how = spark.createDataFrame([(1, [(0, 5, 1.0), (1, 5, 30.0)]), (2, []), (None, [(0, 2, 9.0)]), (3, [(0, 2, 4.0)]), (3, [(0, 2, 6.0), (1, 2, 8.0)])], "doc_id long, passes array<struct<pass:int,words:long,position:double>>")
    out = mixing.stream(docs, how)
    assert out.columns == docs.columns and [(r.text, r.passes) for r in out.collect()] == [("a", 7), ("d", 5), ("d", 5), ("c", 9), ("a", 7)]


def test_very_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "w " * 200_000, "a", 1), (2, "x", "a", 2), (2, "x", "a", 2)], "doc_id long, text string, source string, bucket int")
    for c in ("size", "h", "target", "goal", "demand", "start", "range"):
        docs = docs.withColumn(c, F.lit("z"))
    got = sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect())
    assert [g[:2] for g in got] == [(1, 200_000), (2, 1), (2, 1)] and sum(g[2] for g in got) == 200_002
