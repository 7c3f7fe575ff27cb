"""Graph operators over edge tables ``(a, b)``.

Iterations write each round to the shared folder and stop when nothing
changes or at a stated number of hops; no graph is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import written


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("a", "b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs(node, other)`` with ``least``, the smallest of node and its others; minima are taken before the shuffle."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least")).select(F.col("node").alias("of"), F.least("node", "least").alias("least"))
    return pairs.join(least, F.col("node") == F.col("of")).select("node", "other", "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return _with_least(both).where("other > node and other <> least").select(F.col("other").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    starred = _with_least(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")))
    out = starred.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(starred.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(id, root)``: the smallest id of each node's component.

    Large-star and small-star steps in turn: each node's larger neighbours,
    then its smaller ones, are hung on its smallest neighbour. Chains of n
    nodes take about log n rounds; each round is written to the shared folder.
    """
    now, seen = edges.select("a", "b").where("a <> b"), None
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select("id").join(now, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("root"))


def hops(starts: DataFrame, edges: DataFrame, most: int, blocked: DataFrame | None = None) -> DataFrame:
    """``(start, id, hop)`` of all nodes within ``most`` hops; paths do not go through blocked nodes.

    Level by level: the frontier joins the edges and drops what is seen.
    """
    near = written(both_ways(edges), "edges")
    frontier = written(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop")), "hops")
    seen = frontier
    for h in range(1, most + 1):
        from_ = frontier if blocked is None or h == 1 else frontier.join(blocked.select("id"), "id", "left_anti")
        reached = from_.join(near, from_["id"] == near["a"]).select("start", F.col("b").alias("id")).distinct()
        frontier = written(reached.join(seen, ["start", "id"], "left_anti").withColumn("hop", F.lit(h)), "hops")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def nearest_of(starts: DataFrame, targets: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The nearest target of each start by hops, then id."""
    found = hops(starts, edges, most).where("hop > 0").join(targets.select("id"), "id")
    return found.groupBy("start").agg(F.min(F.struct("hop", "id")).alias("m")).select(F.col("start").alias("id"), F.col("m.id").alias("nearest"), F.col("m.hop").alias("hop"))


def asset_links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of scored nodes, direct or through pass-through nodes only; ``nodes(id, role)`` with scored, pass or other.

    Pass-through nodes that hang together are one component, and all scored
    nodes that touch it are linked to each other. The result is the direct
    links ``(a, b)`` and the membership ``(junction, id)`` of components with
    two scored nodes or more: two members are a link, so a header with
    thousands of branches has thousands of rows, not millions.
    """
    role = nodes.select("id", "role")
    e = edges.join(role.select(F.col("id").alias("a"), F.col("role").alias("ra")), "a").join(role.select(F.col("id").alias("b"), F.col("role").alias("rb")), "b")
    direct = e.where("ra = 'scored' and rb = 'scored' and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    passing = nodes.where("role = 'pass'").select("id")
    comp = components(passing, e.where("ra = 'pass' and rb = 'pass'").select("a", "b"))
    touch = e.where("ra = 'scored' and rb = 'pass'").select(F.col("a").alias("s"), F.col("b").alias("id")).unionByName(e.where("ra = 'pass' and rb = 'scored'").select(F.col("b").alias("s"), F.col("a").alias("id")))
    met = written(touch.join(comp, "id").select(F.col("root").alias("junction"), F.col("s").alias("id")).distinct(), "touch")
    several = met.groupBy("junction").agg(F.count("*").alias("n")).where("n > 1").select("junction")
    return direct, met.join(several, "junction", "left_semi")


def owners(units: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``(id, owner, hop)``: the nearest of ``units(id)`` against the direction of ``edges(a, b)``, by hops, then id; a unit owns itself.

    All units spread at once, a hop a round, so each node is reached once.
    """
    e = written(edges.select("a", "b"), "directed")
    frontier = written(units.select("id", F.col("id").alias("owner"), F.lit(0).alias("hop")), "owned")
    seen = frontier
    for h in range(1, most_rounds + 1):
        reached = frontier.join(e, frontier["id"] == e["a"]).groupBy(F.col("b").alias("id")).agg(F.min("owner").alias("owner")).withColumn("hop", F.lit(h))
        frontier = written(reached.join(seen, "id", "left_anti"), "owned")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"owners did not settle in {most_rounds} rounds")


def shortest(starts: DataFrame, ends: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """``(a, b, hop, path, least)``: the shortest path between each start and the ends it meets first; ``edges(a, b, weight)``.

    A path stops at the first end; of equal lengths the smallest path wins. ``least`` is the smallest weight along it.
    """
    w = edges.select("a", "b", "weight")
    near = written(w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "weighted")
    stop = ends.select("id", F.lit(True).alias("stop"))
    now = starts.select(F.col("id").alias("start"), "id", F.array("id").alias("path"), F.lit(float("inf")).alias("least"))
    found: DataFrame | None = None
    for h in range(1, most + 1):
        step = now.join(near, now["id"] == near["a"]).where(~F.array_contains("path", F.col("b")))
        step = step.select("start", F.col("b").alias("id"), F.array_append("path", F.col("b")).alias("path"), F.least("least", "weight").alias("least"))
        best = step.groupBy("start", "id").agg(F.min(F.struct("path", "least")).alias("m")).select("start", "id", "m.path", "m.least")
        now = written(best.join(stop, "id", "left").withColumn("hop", F.lit(h)), "paths")
        ended = now.where("stop and start <> id").drop("stop")
        found = ended if found is None else found.unionByName(ended)
        now = now.where("stop is null").select("start", "id", "path", "least")
        if now.isEmpty():
            break
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("start", "id").orderBy("hop", "path"))).where("k = 1")
    return first.select(F.col("start").alias("a"), F.col("id").alias("b"), "hop", "path", "least")


def descendants(edges: DataFrame, starts: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Every node below each start along directed edges."""
    frontier = written(starts.select(F.col("id").alias("start"), "id"), "below")
    seen = frontier
    e = edges.select("a", "b")
    for _ in range(most_rounds):
        reached = frontier.join(e, frontier["id"] == e["a"]).select("start", F.col("b").alias("id")).distinct()
        frontier = written(reached.join(seen, ["start", "id"], "left_anti"), "below")
        if frontier.isEmpty():
            return seen.where("start <> id")
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"closure did not end in {most_rounds} rounds")


def combined_directions(evidence: DataFrame) -> DataFrame:
    """``evidence(stream, tier, sign)``: the strongest tier decides; opposite signs inside it are a conflict."""
    per = evidence.groupBy("stream", "tier").agg(F.min("sign").alias("lo"), F.max("sign").alias("hi"))
    best = per.groupBy("stream").agg(F.min(F.struct("tier", "lo", "hi")).alias("m"))
    return best.select("stream", F.col("m.tier").alias("tier"), F.when(F.col("m.lo") != F.col("m.hi"), "conflict").when(F.col("m.lo") > 0, "forward").otherwise("reverse").alias("direction"))


def propagated(directions: DataFrame, valves: DataFrame) -> DataFrame:
    """A stream without a direction takes that of the other stream of a two-ended valve; one hop, from first-hand directions only."""
    two = valves.groupBy("valve").agg(F.count("*").alias("n"), F.min("stream").alias("s1"), F.max("stream").alias("s2")).where("n = 2 and s1 <> s2")
    pairs = two.select(F.col("s1").alias("stream"), F.col("s2").alias("other")).unionByName(two.select(F.col("s2").alias("stream"), F.col("s1").alias("other")))
    known = directions.where("direction <> 'conflict'").select(F.col("stream").alias("other"), "direction")
    got = pairs.join(directions.select("stream"), "stream", "left_anti").join(known, "other")
    return got.groupBy("stream").agg(F.when(F.count_distinct("direction") > 1, "conflict").otherwise(F.min("direction")).alias("direction"))


def sheet_edges(connectors: DataFrame) -> DataFrame:
    """``connectors(sheet, other, direction)``: an edge per pair of sheets; flags that disagree are a conflict."""
    forward = F.when(F.col("sheet") < F.col("other"), F.col("direction")).otherwise(F.when(F.col("direction") == "out", "in").otherwise("out"))
    pairs = connectors.where("sheet <> other").select(F.least("sheet", "other").alias("a"), F.greatest("sheet", "other").alias("b"), forward.alias("d"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("connectors"), F.when(F.count_distinct("d") > 1, "conflict").otherwise(F.min("d")).alias("direction"))
