from millrace import sinks


def test_graph_bundle_lists_what_it_leaves_out(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "tank", "T", "x"), ("b", "pump", "P", "x"), ("a", "valve", "V", "x"), (None, "pump", "Q", "x")], "id string, type string, label string, status string")
    edges = spark.createDataFrame([(2, 1, None, "t", "a", "b", "x"), (1, 5, "own", "t", "b", "a", "x"), (1, 7, None, "t", "a", "zz", "x"), (1, 6, None, "t", "b", "b", "x")], "section int, item long, id string, type string, from string, to string, status string")
    claims = spark.createDataFrame([("a", "size", "3", "list"), ("zz", "size", "4", "list")], "item string, name string, value string, source string")
    events = spark.createDataFrame([("b", "accept", "me", "today")], "item string, decision string, by string, on string")
    path = f"file://{tmp_path}/bundle"
    sinks.graph(nodes, edges, claims, events, path)
    got = {name: {tuple(r) for r in df.collect()} for name, df in sinks.read_graph(spark, path).items()}
    assert {r[:2] for r in got["nodes"]} == {("a", "tank"), ("b", "pump")}
    assert {(r[0], r[2], r[3]) for r in got["edges"]} == {("own", "b", "a"), ("E00002", "b", "b"), ("E00004", "a", "b")}
    assert {r[0] for r in got["claims"]} == {"a"} and {r[0] for r in got["events"]} == {"b"}
    assert got["not_exported"] == {("node", "a", "the id repeats"), ("node", None, "no id"), ("edge", "E00003", "an end is not in the graph"), ("claim", "zz", "its item is not in the graph")}
    sinks.graph(nodes.limit(0), edges.limit(0), claims.limit(0), events.limit(0), path + "2")
    assert all(df.count() == 0 for df in sinks.read_graph(spark, path + "2").values())
