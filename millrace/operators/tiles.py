"""The symbols and links of overlapping tiles merged into those of their sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.matching import containment, iou, near_pairs
from millrace.scratch import written

#: Overlaps from which two boxes are one symbol, and how close to an inner tile edge (in thousandths) a box is cut by it.
SAME_CLASS_IOU = 0.3
CONTAIN = 0.6
CROSS_CLASS_IOU = 0.5
EDGE = 20


def tile_boxes(sheets: DataFrame) -> DataFrame:
    """``(sheet, tile, width, height, px0, py0, px1, py1)``: the tiles of ``sheets(sheet, width, height, cols, rows, overlap)`` in pixels, by rows; edge tiles are flush with the border."""
    size = lambda full, n: F.col(full) / (F.col(n) - (F.col(n) - 1) * F.col("overlap"))
    at = lambda i, full, n, own: F.when(F.col(n) == 1, 0.0).otherwise(F.col(i) * (F.col(full) - own) / (F.col(n) - 1))
    tw, th = size("width", "cols"), size("height", "rows")
    cells = sheets.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    x, y = at("c", "width", "cols", tw), at("r", "height", "rows", th)
    px = lambda v: F.bround(v).cast("int")
    return cells.select("sheet", (F.col("r") * F.col("cols") + F.col("c")).cast("int").alias("tile"), "width", "height", px(x).alias("px0"), px(y).alias("py0"), px(F.least(F.col("width"), x + tw)).alias("px1"), px(F.least(F.col("height"), y + th)).alias("py1"))


def on_sheet(symbols: DataFrame, tiles: DataFrame) -> DataFrame:
    """``symbols(sheet, tile, id, class, tag, confidence, x0, y0, x1, y1)`` of tiles in thousandths of the sheet, with ``edges``: the inner tile edges that cut them."""
    met = symbols.join(tiles, ["sheet", "tile"])
    cut = {
        "left": (F.col("px0") > 0) & (F.col("x0") <= EDGE),
        "top": (F.col("py0") > 0) & (F.col("y0") <= EDGE),
        "right": (F.col("px1") < F.col("width")) & (F.col("x1") >= 1000 - EDGE),
        "bottom": (F.col("py1") < F.col("height")) & (F.col("y1") >= 1000 - EDGE),
    }
    edges = F.array_compact(F.array(*[F.when(test, F.lit(side)) for side, test in cut.items()]))
    x = lambda v: (F.col("px0") + F.col(v) / 1000 * (F.col("px1") - F.col("px0"))) / F.col("width") * 1000
    y = lambda v: (F.col("py0") + F.col(v) / 1000 * (F.col("py1") - F.col("py0"))) / F.col("height") * 1000
    return met.select("sheet", "tile", "id", "class", "tag", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), x("x0").alias("x0"), y("y0").alias("y0"), x("x1").alias("x1"), y("y1").alias("y1"), edges.alias("edges"))


def _across_a_seam() -> Column:
    """One symbol cut in two: both parts touch an inner edge and share half the shorter side along the seam."""
    share = lambda a, b: F.least(F.col(f"a_{b}"), F.col(f"b_{b}")) - F.greatest(F.col(f"a_{a}"), F.col(f"b_{a}"))
    short = lambda a, b: F.least(F.col(f"a_{b}") - F.col(f"a_{a}"), F.col(f"b_{b}") - F.col(f"b_{a}"))
    ix, iy = share("x0", "x1"), share("y0", "y1")
    touched = F.array_union("a_edges", "b_edges")
    upright = F.arrays_overlap(touched, F.array(F.lit("left"), F.lit("right"))) & (iy >= 0.5 * short("y0", "y1"))
    level = F.arrays_overlap(touched, F.array(F.lit("top"), F.lit("bottom"))) & (ix >= 0.5 * short("x0", "x1"))
    return (F.size("a_edges") > 0) & (F.size("b_edges") > 0) & (ix >= 0) & (iy >= 0) & (upright | level)


def candidates(boxes: DataFrame) -> DataFrame:
    """``(sheet, a, b, strength)``: pairs of boxes of different tiles that may be one symbol, a < b; boxes of different classes come after all others."""
    pairs = near_pairs(boxes, boxes, ["sheet"]).where("a_id < b_id and a_tile <> b_tile")
    rated = pairs.withColumns({"iou": iou("a_", "b_"), "contain": containment("a_", "b_"), "seam": _across_a_seam(), "same": F.col("a_class").eqNullSafe(F.col("b_class"))})
    strength = (
        F.when(F.col("same") & ((F.col("iou") >= SAME_CLASS_IOU) | (F.col("contain") >= CONTAIN)), F.greatest("iou", "contain"))
        .when(F.col("same") & F.col("seam"), F.greatest(F.col("iou"), F.lit(0.01)))
        .when(~F.col("same") & (F.col("iou") >= CROSS_CLASS_IOU), F.col("iou") - 0.5)
    )
    return rated.select("sheet", F.col("a_id").alias("a"), F.col("b_id").alias("b"), strength.alias("strength")).where("strength is not null")


def grouped(boxes: DataFrame, pairs: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``(id, symbol)``: pairs join the groups of their ends from the strongest down, a group holding one box of a tile at most; a symbol is its smallest box.

    What a pair does depends on its two groups alone, and only stronger pairs
    at them change these. So a round joins every pair that is the strongest
    open one at both its groups, and drops those whose groups share a tile or
    have become one: the result is that of going through the pairs one by
    one. A group has as many boxes as its sheet has tiles at most.
    """
    alone = boxes.select("id", F.col("id").alias("symbol"), F.array("tile").alias("tiles"))
    near = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    group = written(alone.join(near, "id", "left_semi"), "groups")  # boxes without a pair stay alone
    open_ = written(pairs.select("a", "b", "strength", F.col("a").alias("ga"), F.col("b").alias("gb")), "pairs")
    for _ in range(most_rounds):
        tiles = group.groupBy("symbol").agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
        at = lambda side: tiles.select(F.col("symbol").alias(f"g{side}"), F.col("tiles").alias(f"t{side}"))
        live = written(open_.join(at("a"), "ga").join(at("b"), "gb").where(~F.arrays_overlap("ta", "tb")).select("a", "b", "strength", "ga", "gb"), "pairs")
        if live.isEmpty():
            return alone.select("id", F.col("symbol").alias("_own")).join(group.select("id", "symbol"), "id", "left").select("id", F.coalesce("symbol", "_own").alias("symbol"))
        rank = F.struct("strength", "a", "b")
        ends = live.select(F.col("ga").alias("g"), rank.alias("rank")).unionByName(live.select(F.col("gb").alias("g"), rank.alias("rank")))
        top = ends.groupBy("g").agg(F.max("rank").alias("top"))
        best = live.join(top.select(F.col("g").alias("ga"), F.col("top").alias("pa")), "ga").join(top.select(F.col("g").alias("gb"), F.col("top").alias("pb")), "gb").where((F.col("pa") == rank) & (F.col("pb") == rank))
        joined = best.select(F.least("ga", "gb").alias("to"), F.greatest("ga", "gb").alias("symbol"))
        moved = written(joined, "joined")
        group = written(group.join(moved, "symbol", "left").select("id", F.coalesce("to", "symbol").alias("symbol"), "tiles"), "groups")
        name = lambda side: moved.select(F.col("symbol").alias(f"g{side}"), F.col("to").alias(f"to{side}"))
        renamed = live.join(name("a"), "ga", "left").join(name("b"), "gb", "left")
        open_ = renamed.select("a", "b", "strength", F.coalesce("toa", "ga").alias("ga"), F.coalesce("tob", "gb").alias("gb")).where("ga <> gb")
    raise RuntimeError(f"tiles did not merge in {most_rounds} rounds")


def merge_tiles(boxes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, links and counts by sheet of ``boxes`` (see ``on_sheet``; ids are unique over all sheets) and ``links(sheet, a, b)`` of the tiles.

    A symbol's class and tag are those of its surest box (the tag of the first
    box with one, where it has none), ties going to the smaller id; its box is
    that of the surest box that no tile edge cuts, else all boxes together.
    Links whose ends are unknown or became one symbol are dropped, and a link
    that several tiles show comes out once.
    """
    of = written(grouped(boxes, written(candidates(boxes), "candidates")), "symbols")
    own = boxes.join(of, "id")
    sure = lambda c, when=F.lit(True): F.max_by(c, F.when(when, F.struct("confidence", -F.col("id"))))
    whole = F.size("edges") == 0
    box = lambda c, far: F.round(F.coalesce(sure(F.col(c), whole), far(c)), 1).alias(c)
    has_tag = F.coalesce(F.col("tag"), F.lit("")) != ""
    first_tag = F.min_by(F.col("tag"), F.when(has_tag, F.col("id")))
    surest_tag = sure(F.coalesce(F.col("tag"), F.lit("")))
    symbols = own.groupBy("sheet", F.col("symbol").alias("id")).agg(
        sure(F.col("class")).alias("class"), F.when(surest_tag != "", surest_tag).otherwise(first_tag).alias("tag"),
        box("x0", F.min), box("y0", F.min), box("x1", F.max), box("y1", F.max),
        F.round(F.max("confidence"), 3).alias("confidence"), F.array_sort(F.collect_set("tile")).alias("tiles"), F.array_sort(F.collect_list("id")).alias("parts"),
        (F.count_if(whole) == 0).alias("cut"), F.count_distinct(F.coalesce("class", F.lit(""))).alias("classes"),
    )
    symbols = written(symbols, "symbols")
    end = lambda side: of.select(F.col("id").alias(side), F.col("symbol").alias(f"s{side}"))
    known = written(links.join(end("a"), "a", "left").join(end("b"), "b", "left"), "links")
    good = known.where("sa is not null and sb is not null and sa <> sb")
    out = good.select("sheet", F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct()
    several = F.size("parts") > 1
    counts = symbols.groupBy("sheet").agg(F.sum(F.size("parts")).alias("tile_symbols"), F.count("*").alias("symbols"), F.count_if(several).alias("merged_groups"), F.count_if(several & F.col("cut")).alias("seam_unions"), F.count_if(several & (F.col("classes") > 1)).alias("cross_class_merges"))
    drawn = known.groupBy("sheet").agg(F.count("*").alias("tile_links"), (F.count("*") - F.count_if(F.coalesce(F.col("sa") != F.col("sb"), F.lit(False)))).alias("links_dropped"))
    tile_of = boxes.select("id", "tile")
    shown = good.join(tile_of.withColumnRenamed("id", "a"), "a").select("sheet", "tile", F.explode(F.array("sa", "sb")).alias("symbol"))
    stitched = shown.groupBy("sheet", "symbol").agg(F.count_distinct("tile").alias("n")).where("n > 1").groupBy("sheet").agg(F.count("*").alias("stitch_symbols"))
    stats = counts.join(drawn, "sheet", "left").join(out.groupBy("sheet").agg(F.count("*").alias("links")), "sheet", "left").join(stitched, "sheet", "left").fillna(0, ["tile_links", "links_dropped", "links", "stitch_symbols"])
    return symbols.drop("cut", "classes"), out, stats
