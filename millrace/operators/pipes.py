"""Pipe layers of line graphs: contraction (G03), networks and line classes (G04) and their score.

Node ids are unique over all sheets, so every sheet is worked on at once; each
round is written to the shared folder. Segments are ``(a, b, network)`` with
a < b.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graphs import components
from millrace.scratch import written


def _ends(segments: DataFrame) -> DataFrame:
    """``(id, other, network)``: each segment from both of its ends."""
    return segments.select(F.col("a").alias("id"), F.col("b").alias("other"), "network").unionByName(segments.select(F.col("b").alias("id"), F.col("a").alias("other"), "network"))


def _as(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def contract(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Segments and junctions of ``nodes(id, item)`` and the drawn lines ``edges(a, b, network)``.

    A node that is not an item goes as long as it has fewer than three
    different neighbours: with two, these become neighbours (bends, pass
    points, double lines), with one it was a dead end. What stays joins three
    or more. A round takes all such nodes at once: those that hang together
    are a path or a ring, found by ``components`` in rounds logarithmic in its
    length, and each path is replaced by one line between what it hangs on. So
    a round also cuts every branch that has no fork, and rounds are at most
    logarithmic in the number of nodes. Which nodes stay does not depend on
    the order. Components with fewer than two items go.

    The network of a segment is that of the line at its smaller end, of
    several the smallest. Returns ``(a, b, network)`` and ``(id, arms)``. Lines
    from a node to itself, repeated lines and nodes without a line have no
    effect; null ends are dropped.
    """
    plain = nodes.where("not item").select("id")
    lines = edges.where("a <> b").select("a", "b", "network")
    # A line from each end, with the network it has there.
    now = written(_ends(lines).groupBy("id", "other").agg(F.min("network").alias("network")), "lines")
    for _ in range(most_rounds):
        going = written(now.groupBy("id").agg(F.count("*").alias("n")).where("n < 3").join(plain, "id", "left_semi").select("id"), "going")
        if going.isEmpty():
            break
        marked = now.join(_as(going, id="id").withColumn("go", F.lit(True)), "id", "left").join(_as(going, other="id").withColumn("other_go", F.lit(True)), "other", "left").select("id", "other", "network", F.coalesce("go", F.lit(False)).alias("go"), F.coalesce("other_go", F.lit(False)).alias("other_go"))
        marked = written(marked, "marked")
        paths = components(going, marked.where("go and other_go").select(F.col("id").alias("a"), F.col("other").alias("b")))
        hung = marked.where("not go and other_go").join(_as(paths, other="id", root="root"), "other").groupBy("root", "id").agg(F.min("network").alias("network"))
        both = hung.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("id", "network")).alias("x"), F.max(F.struct("id", "network")).alias("y")).where("n = 2")
        made = both.select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), F.col("x.network").alias("network")).unionByName(both.select(F.col("y.id").alias("id"), F.col("x.id").alias("other"), F.col("y.network").alias("network")))
        stay = marked.where("not go and not other_go").select("id", "other", "network").unionByName(made)
        now = written(stay.groupBy("id", "other").agg(F.min("network").alias("network")), "lines")
    else:
        raise RuntimeError(f"contraction did not end in {most_rounds} rounds")
    segments = now.where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "network")
    pieces = written(components(now.select("id").distinct(), segments), "pieces")
    joined = pieces.join(nodes.where("item").select("id").distinct(), "id", "left_semi").groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    kept = pieces.join(joined, "root", "left_semi").select("id")
    arms = now.join(kept, "id", "left_semi").join(plain, "id", "left_semi").groupBy("id").agg(F.count("*").alias("arms"))
    return segments.join(_as(kept, a="id"), "a", "left_semi").select("a", "b", "network"), arms


def networks(segments: DataFrame, junctions: DataFrame) -> DataFrame:
    """``(network, kind, id)``: connected lines without an item in them, as their junctions and the items on them.

    A network is named by its smallest junction; a segment between two items
    is a network of its own, named by both ends.
    """
    j = junctions.select("id")
    marked = segments.select("a", "b").join(_as(j, a="id").withColumn("ja", F.lit(True)), "a", "left").join(_as(j, b="id").withColumn("jb", F.lit(True)), "b", "left")
    marked = written(marked.select("a", "b", F.coalesce("ja", F.lit(False)).alias("ja"), F.coalesce("jb", F.lit(False)).alias("jb")), "marked")
    groups = written(components(j, marked.where("ja and jb").select("a", "b")), "groups")
    hung = marked.where("ja and not jb").select(F.col("a").alias("j"), F.col("b").alias("item")).unionByName(marked.where("jb and not ja").select(F.col("b").alias("j"), F.col("a").alias("item")))
    members = hung.join(_as(groups, j="id", root="root"), "j").select(F.col("root").cast("string").alias("network"), F.lit("item").alias("kind"), F.col("item").alias("id")).distinct()
    lone = marked.where("not ja and not jb").select(F.concat_ws("-", "a", "b").alias("network"), F.lit("item").alias("kind"), F.explode(F.array("a", "b")).alias("id"))
    own = groups.select(F.col("root").cast("string").alias("network"), F.lit("junction").alias("kind"), "id")
    return own.unionByName(members).unionByName(lone)


def folded(segments: DataFrame, arms: DataFrame, actuators: DataFrame, most_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Rule 1: a junction that joins an actuator and its valve folds into the valve; ``actuators(id, valve)``.

    Junctions take their turn by id, and one that folded gives its neighbours
    the valve as a neighbour. Only junctions with an actuator at them can ever
    fold, so a round takes each of these whose smaller neighbours of that kind
    are done: rounds follow the size of a cluster of such junctions.
    """
    actuators = actuators.select(F.col("id").alias("actuator"), "valve")
    now, left = written(segments, "segments"), written(_ends(segments).join(_as(arms, id="id"), "id", "left_semi").join(actuators, F.col("other") == F.col("actuator"), "left_semi").select("id").distinct(), "turns")
    gone = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        ends = _ends(now)
        waits = ends.where("other < id").join(_as(left, other="id"), "other", "left_semi").select("id").distinct()
        turn = left.join(waits, "id", "left_anti")
        near = written(ends.join(turn, "id", "left_semi"), "near")
        hit = near.join(actuators, F.col("other") == F.col("actuator")).select("id", "actuator", "valve").join(_as(near, id="id", valve="other"), ["id", "valve"], "left_semi")
        hits = written(hit.groupBy("id").agg(F.min(F.struct("actuator", "valve")).alias("m")).select("id", "m.valve"), "hits")
        fresh = near.join(hits, "id").where("other <> valve").groupBy(F.least("other", "valve").alias("a"), F.greatest("other", "valve").alias("b")).agg(F.min(F.struct("id", "network")).alias("m")).select("a", "b", F.col("m.network").alias("network"))
        kept = now.join(_as(hits, a="id"), "a", "left_anti").join(_as(hits, b="id"), "b", "left_anti").select("a", "b", "network")
        now = written(kept.unionByName(fresh.join(kept, ["a", "b"], "left_anti")), "segments")
        left = written(left.join(turn, "id", "left_anti"), "turns")
        gone = hits.select("id") if gone is None else gone.unionByName(hits.select("id"))
    else:
        raise RuntimeError(f"assemblies did not end in {most_rounds} rounds")
    return now, arms if gone is None else arms.join(gone, "id", "left_anti")


def _line(segments: DataFrame, roles: DataFrame) -> DataFrame:
    """Rule 2: ``(a, b, network, line, start)`` by the roles of the ends; start is the end that the line is read from."""
    r = roles.select("id", "role", "of")
    at = segments.join(_as(r, a="id", ra="role", fa="of"), "a", "left").join(_as(r, b="id", rb="role", fb="of"), "b", "left")
    is_ = lambda side, role: F.coalesce(F.col(f"r{side}") == role, F.lit(False))
    own = lambda side, role, other: is_(side, role) & F.coalesce(F.col(f"f{side}") == F.col(other), F.lit(False))
    rules = [
        (own("a", "actuator", "b"), "actuator", "b"),
        (own("b", "actuator", "a"), "actuator", "a"),
        (own("a", "nozzle", "b"), "nozzle", "a"),
        (own("b", "nozzle", "a"), "nozzle", "b"),
        (is_("a", "instrument"), "instrument", "a"),
        (is_("b", "instrument"), "instrument", "b"),
        (is_("a", "actuator"), "instrument", "a"),
        (is_("b", "actuator"), "instrument", "b"),
    ]
    first = reduce(lambda rest, rule: F.when(rule[0], F.struct(F.lit(rule[1]).alias("line"), F.col(rule[2]).alias("start"))).otherwise(rest), reversed(rules), F.struct(F.lit("process").alias("line"), F.col("a").alias("start")))
    return at.withColumn("m", first).select("a", "b", "network", "m.line", "m.start")


def _sums(lines: DataFrame, only: DataFrame) -> DataFrame:
    """``(id, n, process, instrument, p)``: lines at each node of ``only``; p is the other end of its smallest process line."""
    both = lines.select(F.col("a").alias("id"), F.col("b").alias("other"), "line").unionByName(lines.select(F.col("b").alias("id"), F.col("a").alias("other"), "line"))
    of = lambda kind: F.count_if(F.col("line") == kind)
    return both.join(only.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"), of("process").alias("process"), of("instrument").alias("instrument"), F.min(F.when(F.col("line") == "process", F.col("other"))).alias("p"))


def carried(lines: DataFrame, arms: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Rule 3: at a junction of instrument lines with one process line left, that line is an instrument line too, until nothing changes.

    Only junctions at a line that changed in the last round are looked at
    again. Where both ends of a line would carry it on in one round, it is
    read from the smaller.
    """
    now, again = written(lines, "carried"), arms.select("id")
    for _ in range(most_rounds):
        sums = _sums(now, again).join(arms, "id").where("process = 1 and instrument > 0 and n = arms")
        change = written(sums.groupBy(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).agg(F.min("id").alias("from")), "changes")
        if change.isEmpty():
            return now
        joined = now.join(change, ["a", "b"], "left")
        now = written(joined.select("a", "b", "network", F.when(F.col("from").isNotNull(), "instrument").otherwise(F.col("line")).alias("line"), F.coalesce("from", "start").alias("start")), "carried")
        again = change.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    raise RuntimeError(f"instrument lines did not settle in {most_rounds} rounds")


def junction_kinds(lines: DataFrame, arms: DataFrame) -> DataFrame:
    """Rule 4: ``(id, arms, kind)``."""
    kind = F.when((F.col("process") >= 3) | (F.col("instrument") == 0), "pipe_tee").when(F.col("process") == 2, "instrument_tap").otherwise("instrument_line_junction")
    some = arms.join(_sums(lines, arms), "id", "left").fillna(0, ["process", "instrument"])
    return some.select("id", "arms", kind.alias("kind"))


def through_taps(lines: DataFrame, kinds: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Rule 5: process lines joined through instrument taps.

    Every tap has two process lines, so taps form paths. A line read in a
    direction points to the next one beyond its tap; pointers are doubled
    until each has met the path's end, which also counts the taps in between.
    Returns pipe ``(a, b, network, taps)``, taps in order from a to b and the
    network that it has at a, and the taps passed ``(id, a, b)``. A path that ends where it began, or has no
    end, keeps its pieces.
    """
    taps = kinds.where("kind = 'instrument_tap'").select("id")
    process = lines.where("line = 'process'").select("a", "b", "network")
    ends = _ends(process)
    at_tap = written(ends.join(taps, "id", "left_semi").join(_as(taps, other="id").withColumn("on", F.lit(True)), "other", "left").select("id", "other", "network", F.coalesce("on", F.lit(False)).alias("on")), "at-tap")
    # An arc (tap, next node); beyond a tap it goes on by that tap's other line.
    onward = at_tap.select(F.col("id").alias("u"), F.col("other").alias("v"), "on")
    two = at_tap.groupBy("id").agg(F.min("other").alias("x"), F.max("other").alias("y"))
    step = onward.join(_as(two, v="id", x="x", y="y"), "v", "left").select("u", "v", F.when(F.col("on"), F.struct(F.col("v").alias("u"), F.when(F.col("x") == F.col("u"), F.col("y")).otherwise(F.col("x")).alias("v"))).alias("next"), F.when(~F.col("on"), F.col("v")).alias("end"), F.when(~F.col("on"), F.col("u")).alias("tip"), F.lit(1).cast("long").alias("far"))
    now, open_ = written(step, "arcs"), None
    for _ in range(most_rounds):
        count = now.where("end is null").count()
        if count in (0, open_):  # those left go round in a ring
            break
        open_ = count
        of = now.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("next").alias("next2"), F.col("end").alias("end2"), F.col("tip").alias("tip2"), F.col("far").alias("far2"))
        jumped = now.where("end is null").join(of, (F.col("next.u") == F.col("nu")) & (F.col("next.v") == F.col("nv")))
        now = written(now.where("end is not null").unionByName(jumped.select("u", "v", F.col("next2").alias("next"), F.col("end2").alias("end"), F.col("tip2").alias("tip"), (F.col("far") + F.col("far2")).alias("far"))), "arcs")
    else:
        raise RuntimeError(f"taps did not settle in {most_rounds} rounds")
    sides = now.where("end is not null").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"), F.min(F.struct("end", "far", "tip")).alias("lo"), F.max(F.struct("end", "far", "tip")).alias("hi"))
    passed = written(sides.where("n = 2 and lo.end < hi.end").select("id", F.col("lo.end").alias("a"), F.col("hi.end").alias("b"), F.col("lo.far").alias("place"), F.col("lo.tip").alias("path")), "passed")
    # Two pipes between the same ends are one segment: the taps of the one with the smaller first tap come first.
    first = passed.where("place = 1").select("a", "b", "path")
    ordered = passed.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("path", "place", "id"))).alias("taps"))
    net_at = _as(at_tap, path="id", a="other", network="network")
    named = first.join(net_at, ["path", "a"]).groupBy("a", "b").agg(F.min(F.struct("path", "network")).alias("m")).select("a", "b", "m.network")
    merged = ordered.join(named, ["a", "b"]).select("a", "b", "network", F.col("taps.id").alias("taps"))
    gone = passed.select("id")
    plain = process.join(_as(gone, a="id"), "a", "left_anti").join(_as(gone, b="id"), "b", "left_anti").select("a", "b", "network")
    met = plain.select("a", "b", F.col("network").alias("own")).join(merged, ["a", "b"], "full_outer")
    taps_of = F.coalesce("taps", F.array().cast(merged.schema["taps"].dataType))
    return met.select("a", "b", F.coalesce("own", "network").alias("network"), taps_of.alias("taps")), passed.select("id", "a", "b")


def classify(segments: DataFrame, arms: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each line is; ``roles(id, role, of)`` with instrument, actuator (of a valve) or nozzle (of a vessel).

    Returns pipe ``(a, b, network, taps)``; other lines ``(line, start, end,
    network)``; junctions ``(id, arms, kind, tap_a, tap_b)`` with the pipe that a
    tap sits on. A tap that could not be passed is a pipe tee.
    """
    kept, left = folded(segments, arms, roles.where("role = 'actuator'").select("id", F.col("of").alias("valve")))
    lines = carried(_line(kept, roles), left)
    kinds = junction_kinds(lines, left)
    pipe, passed = through_taps(lines, kinds)
    others = lines.where("line <> 'process'").select("line", "start", F.when(F.col("start") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("end"), "network")
    on = kinds.join(passed.select("id", F.col("a").alias("tap_a"), F.col("b").alias("tap_b")), "id", "left")
    kind = F.when((F.col("kind") == "instrument_tap") & F.col("tap_a").isNull(), "pipe_tee").otherwise(F.col("kind"))
    return pipe, others, on.select("id", "arms", kind.alias("kind"), "tap_a", "tap_b")


def _rates(tp: Column, predicted: Column, truth: Column) -> list[Column]:
    share = lambda x, n: F.when(n > 0, F.round(x / n, 3)).otherwise(0.0)
    return [share(tp, predicted).alias("precision"), share(tp, truth).alias("recall"), share(2 * tp, predicted + truth).alias("f1")]


def pipe_score(pred: DataFrame, truth: DataFrame, pred_junctions: DataFrame, truth_junctions: DataFrame, match: DataFrame) -> DataFrame:
    """``(sheet, layer, tp, predicted, truth, precision, recall, f1)`` with a row of all sheets (sheet null) for each layer.

    ``pred(sheet, layer, a, b)`` and ``truth`` of the same columns hold lines of
    the layers ``pipe`` and ``instrument``; junctions are ``(sheet, id, kind)``
    and ``match(sheet, pred, truth)`` pairs them one to one. A predicted line is
    right if its ends, after matching, are a true line of its layer. Further
    layers: item_to_item (pipe lines without a junction), junctions (matched
    ones) and junction_kinds (matched ones of the same kind). Lines have no
    direction; repeated lines count once; a sheet that only one side has counts
    with zeros on the other.
    """
    line = lambda df: df.select("sheet", "layer", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    free = lambda df, j: df.where("layer = 'pipe'").join(j.select("sheet", F.col("id").alias("a")), ["sheet", "a"], "left_anti").join(j.select("sheet", F.col("id").alias("b")), ["sheet", "b"], "left_anti").select("sheet", F.lit("item_to_item").alias("layer"), "a", "b")
    own, real = line(pred), line(truth)
    own = own.unionByName(free(own, pred_junctions))
    real = real.unionByName(free(real, truth_junctions))
    at = lambda df, end: df.join(pred_junctions.select("sheet", F.col("id").alias(end), F.lit(True).alias("is_j")), ["sheet", end], "left").join(match.select("sheet", F.col("pred").alias(end), F.col("truth").alias("to")), ["sheet", end], "left").withColumn(end, F.when(F.col("to").isNotNull(), F.col("to")).when(F.col("is_j").isNull(), F.col(end))).drop("is_j", "to")
    mapped = at(at(own, "a"), "b").where("a is not null and b is not null")  # a junction without a match is no true end
    hit = line(mapped).join(real, ["sheet", "layer", "a", "b"], "left_semi")
    n = lambda df, name: df.groupBy("sheet", "layer").agg(F.count("*").alias(name))
    as_layer = lambda df, layer: df.select("sheet", F.lit(layer).alias("layer"))
    same = match.join(pred_junctions.select("sheet", F.col("id").alias("pred"), F.col("kind").alias("pk")), ["sheet", "pred"]).join(truth_junctions.select("sheet", F.col("id").alias("truth"), F.col("kind").alias("tk")), ["sheet", "truth"]).where("pk = tk")
    counts = [
        n(hit.select("sheet", "layer").unionByName(as_layer(match, "junctions")).unionByName(as_layer(same, "junction_kinds")), "tp"),
        n(own.select("sheet", "layer").unionByName(as_layer(pred_junctions, "junctions")).unionByName(as_layer(match, "junction_kinds")), "predicted"),
        n(real.select("sheet", "layer").unionByName(as_layer(truth_junctions, "junctions")).unionByName(as_layer(match, "junction_kinds")), "truth"),
    ]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "predicted", "truth")]
    joined = counts[0].unionByName(counts[1], True).unionByName(counts[2], True)
    by_sheet = joined.groupBy("sheet", "layer").agg(*sums)
    total = joined.groupBy("layer").agg(*sums).withColumn("sheet", F.lit(None).cast(by_sheet.schema["sheet"].dataType))
    return by_sheet.unionByName(total).select("sheet", "layer", "tp", "predicted", "truth", *_rates(F.col("tp"), F.col("predicted"), F.col("truth")))
