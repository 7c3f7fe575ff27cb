"""Audits of drawings: loops along signal lines, off-page connectors, parents of instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import jaccard, tag_compact
from millrace.scratch import written


def loop_audit(loops: DataFrame, symbols: DataFrame, signals: DataFrame) -> DataFrame:
    """Each of ``loops(loop, controller, measurement, output)`` against ``symbols(drawing, id, text, signal_to, signal_from)`` and ``signals(drawing, a, b)``.

    controller, measurement and output: a symbol carries the tag. signal_in: a
    signal line joins measurement and controller, or they are one tag.
    signal_out: one joins controller and output, or the controller has one to
    a flag that names the output and a flag that names the controller has one
    to the output. The status is drawn, partly_drawn or not_drawn (no controller).
    """
    key = lambda c: tag_compact(F.coalesce(F.col(c), F.lit("")))
    asked = loops.select("loop", F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), key(c).alias("key")) for role, kind, c in (("controller", "text", "controller"), ("measurement", "text", "measurement"), ("output", "text", "output"), ("flag_out", "to", "output"), ("flag_in", "from", "controller"))])).alias("x")).select("loop", "x.*").where("key <> ''")
    said = symbols.select("drawing", "id", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), key(c).alias("key")) for kind, c in (("text", "text"), ("to", "signal_to"), ("from", "signal_from"))])).alias("x")).select("drawing", "id", "x.*").where("key <> ''")
    refs = written(asked.join(said, ["kind", "key"]).select("loop", "role", "drawing", "id"), "loop-symbols")
    lines = signals.select("drawing", "a", "b").unionByName(signals.select("drawing", F.col("b").alias("a"), F.col("a").alias("b")))
    reached = refs.join(lines, (refs["drawing"] == lines["drawing"]) & (refs["id"] == lines["a"])).select("loop", F.col("role").alias("from"), refs["drawing"], F.col("b").alias("id"))
    joined = reached.join(refs, ["loop", "drawing", "id"]).groupBy("loop").agg(*[F.max((F.col("from") == a) & (F.col("role") == b)).alias(n) for n, a, b in (("into", "measurement", "controller"), ("out", "controller", "output"), ("leaves", "controller", "flag_out"), ("arrives", "flag_in", "output"))])
    there = refs.groupBy("loop").agg(*[F.max(F.col("role") == r).alias(r) for r in ("controller", "measurement", "output")])
    one = loops.select("loop", (key("controller") == key("measurement")).alias("combined")).join(there, "loop", "left").join(joined, "loop", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    checks = one.select("loop", "combined", *[yes(c).alias(c) for c in ("controller", "measurement", "output")], (yes("into") | (F.col("combined") & yes("controller"))).alias("signal_in"), (yes("controller") & (yes("out") | (yes("leaves") & yes("arrives")))).alias("signal_out"))
    whole = F.col("measurement") & F.col("output") & F.col("signal_in") & F.col("signal_out")
    return checks.withColumn("status", F.when(~F.col("controller"), "not_drawn").when(whole, "drawn").otherwise("partly_drawn"))


def _greedy(pairs: DataFrame, order: list[Column], most_rounds: int = 200) -> DataFrame:
    """The one-to-one choice among ``pairs(a, b, ...)`` in the stated order, an end being used once on either side.

    A round takes the pairs that are first for both their ends.
    """
    taken: DataFrame | None = None
    left = written(pairs, "pairs")
    for _ in range(most_rounds):
        ranked = left.select("*", F.explode(F.array("a", "b")).alias("_end")).withColumn("_k", F.row_number().over(Window.partitionBy("_end").orderBy(*order)))
        best = written(ranked.where("_k = 1").groupBy(*pairs.columns).agg(F.count("*").alias("_n")).where("_n = 2").drop("_n"), "best")
        taken = best if taken is None else taken.unionByName(best)
        used = best.select(F.explode(F.array("a", "b")).alias("_end"))
        left = written(left.join(used, F.col("a") == F.col("_end"), "left_anti").join(used, F.col("b") == F.col("_end"), "left_anti"), "pairs")
        if left.isEmpty():
            return taken
    raise RuntimeError(f"pairing did not end in {most_rounds} rounds")


def pair_connectors(connectors: DataFrame, sheets: DataFrame) -> DataFrame:
    """``(id, pair, method, similarity, status)`` of off-page ``connectors(id, sheet, ref, code, words)`` on ``sheets(sheet, number, system_code)``.

    Two connectors may pair if each names the other's sheet, or if one names
    the other's sheet, its own has no number, and the other's code is that of
    its system. Pairs are chosen one to one by falling word overlap,
    reciprocal ones first, then ids. The others are told why they have none.
    """
    s = sheets.select("sheet", F.when(F.coalesce("number", F.lit("")) != "", F.col("number")).alias("number"), "system_code")
    known = s.where("number is not null").select(F.col("number").alias("n")).distinct()
    own = connectors.join(s, "sheet", "left").withColumn("ref", F.when(F.coalesce("ref", F.lit("")) != "", F.col("ref")))
    own = written(own.join(known, F.col("ref") == F.col("n"), "left").withColumn("listed", F.col("n").isNotNull()).drop("n"), "connectors")
    x, y = own.alias("x"), own.alias("y")
    met = x.join(y, (F.col("x.ref") == F.col("y.number")) & (F.col("x.sheet") != F.col("y.sheet")))
    both = F.col("y.ref") == F.col("x.number")
    one_way = F.col("x.number").isNull() & ~F.col("y.listed") & (F.coalesce("y.code", F.lit("")) != "") & (F.col("y.code") == F.col("x.system_code"))
    rated = met.withColumn("way", F.when(both, 0).when(one_way, 1)).where("way is not null").select(F.col("x.id").alias("p"), F.col("y.id").alias("q"), "way", F.coalesce(jaccard(F.col("x.words"), F.col("y.words")), F.lit(0.0)).alias("similarity"))
    ends = rated.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "way", "p", "q")).alias("m"))
    chosen = _greedy(ends.select("a", "b", (-F.col("m.s")).alias("similarity"), F.col("m.way").alias("way"), F.col("m.p").alias("p"), F.col("m.q").alias("q")), [F.desc("similarity"), F.col("way"), F.col("p"), F.col("q")])
    sides = chosen.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("pair")), F.struct(F.col("b").alias("id"), F.col("a").alias("pair")))).alias("x"), "similarity", "way").select("x.*", "similarity", "way")
    out = own.join(sides, "id", "left")
    reason = (
        F.when(F.col("pair").isNotNull(), "paired")
        .when(F.col("ref").isNull(), "unpaired: no drawing number read from the text")
        .when(F.col("listed") & ~F.coalesce(F.col("number") == F.col("ref"), F.lit(False)), "unpaired: no connector on the target sheet matches")
        .when(F.col("listed"), "unpaired: points to its own sheet number")
        .otherwise("unpaired: target drawing is not in this sheet set")
    )
    return out.select("id", "pair", F.when(F.col("way") == 0, "reciprocal").when(F.col("way") == 1, "one way and system code").alias("method"), "similarity", reason.alias("status"))


def _middle(p: str) -> tuple[Column, Column]:
    return (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2, (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2


def _distance(p: str, q: str) -> Column:
    (px, py), (qx, qy) = _middle(p), _middle(q)
    return F.hypot(px - qx, py - qy)


def _gap(p: str, q: str) -> Column:
    c = lambda s, n: F.col(f"{s}{n}")
    dx = F.greatest(F.lit(0.0), c(q, "x0") - c(p, "x1"), c(p, "x0") - c(q, "x1"))
    dy = F.greatest(F.lit(0.0), c(q, "y0") - c(p, "y1"), c(p, "y0") - c(q, "y1"))
    return F.hypot(dx, dy)


BOX = ("x0", "y0", "x1", "y1")


def parents(items: DataFrame, links: DataFrame, most_hops: int = 1000) -> DataFrame:
    """``(id, parent, method, nearest, agrees)`` of the instruments among ``items(id, sheet, role, x0, y0, x1, y1)``, with ``links(a, b)``.

    The closest linked item that is no instrument; else the closest one at the
    end of a chain of instruments, the first chain by length, then by ids;
    else the item of its sheet with the smallest gap. ``nearest`` is the last
    of these for every instrument, as a second opinion.
    """
    side = lambda p: items.select(F.col("id").alias(f"{p}id"), F.col("sheet").alias(f"{p}sheet"), F.col("role").alias(f"{p}role"), *[F.col(c).cast("double").alias(f"{p}{c}") for c in BOX])
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().join(items.select(F.col("id").alias("b"), (F.col("role") == "instrument").alias("more")), "b").select("a", "b", "more"), "links")
    instruments = items.where("role = 'instrument'").select("id")
    pick = lambda found: found.join(side("i_"), F.col("id") == F.col("i_id")).join(side("p_"), F.col("parent") == F.col("p_id")).groupBy("id").agg(F.min(F.struct(_distance("i_", "p_").alias("d"), F.col("parent").alias("parent"))).alias("m")).select("id", "m.parent")
    # Level by level through instruments: the first chain that ends at another item decides.
    paths = written(instruments.select("id", F.col("id").alias("at"), F.array("id").alias("path")), "chains")
    seen, found = paths.select("id", "at"), None
    for hop in range(most_hops):
        step = paths.join(both, paths["at"] == both["a"])
        ends = step.where("not more").groupBy("id", "at").agg(F.min("path").alias("path"), F.collect_set("b").alias("ends"))  # neighbours of one item
        first = written(ends.groupBy("id").agg(F.min(F.struct("path", "ends")).alias("m")).select("id", F.explode("m.ends").alias("parent")), "ends")
        done = pick(first).withColumn("method", F.lit("linked" if hop == 0 else "via instruments"))
        found = done if found is None else found.unionByName(done)
        on = step.where("more").join(first.select("id").distinct(), "id", "left_anti").select("id", F.col("b").alias("at"), F.array_append("path", F.col("b")).alias("path"))
        paths = written(on.groupBy("id", "at").agg(F.min("path").alias("path")).join(seen, ["id", "at"], "left_anti"), "chains")
        if paths.isEmpty():
            break
        seen = seen.unionByName(paths.select("id", "at"))
    else:
        raise RuntimeError(f"chains did not end in {most_hops} hops")
    near = side("i_").where("i_role = 'instrument'").join(side("p_").where("p_role <> 'instrument'"), F.col("i_sheet") == F.col("p_sheet"))
    nearest = near.groupBy(F.col("i_id").alias("id")).agg(F.min(F.struct(_gap("i_", "p_").alias("g"), F.col("p_id").alias("nearest"))).alias("m")).select("id", "m.nearest")
    out = instruments.join(found, "id", "left").join(nearest, "id", "left")
    parent = F.coalesce("parent", "nearest")
    method = F.coalesce("method", F.when(F.col("nearest").isNotNull(), "nearest").otherwise("none"))
    return out.select("id", parent.alias("parent"), method.alias("method"), "nearest", F.coalesce(parent == F.col("nearest"), F.lit(False)).alias("agrees"))
