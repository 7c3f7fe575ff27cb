"""Spatial joins and one-to-one matching of boxes.

Boxes have sheet, id and x0, y0, x1, y1. Candidates meet through grid cells of
their sheet, so a sheet's boxes are not all paired; one-to-one matches are
found by rounds of mutually best pairs, which under a strict order equal the
sequential greedy choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import written

BOX = ("x0", "y0", "x1", "y1")


# ---- F01: geometry


def _side(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def area(prefix: str) -> Column:
    x0, y0, x1, y1 = _side(prefix)
    return (x1 - x0) * (y1 - y0)


def overlap_area(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = _side(a)
    bx0, by0, bx1, by1 = _side(b)
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(zero, F.least(ay1, by1) - F.greatest(ay0, by0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 for an empty union."""
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(a: str, b: str) -> Column:
    """Overlap as a share of the smaller box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(F.lit(0.0))


def gap(a: str, b: str) -> Column:
    """Distance between two boxes, 0 where they touch."""
    ax0, ay0, ax1, ay1 = _side(a)
    bx0, by0, bx1, by1 = _side(b)
    dx = F.greatest(F.lit(0.0), bx0 - ax1, ax0 - bx1)
    dy = F.greatest(F.lit(0.0), by0 - ay1, ay0 - by1)
    return F.sqrt(dx * dx + dy * dy)


def centre_distance(a: str, b: str) -> Column:
    ax0, ay0, ax1, ay1 = _side(a)
    bx0, by0, bx1, by1 = _side(b)
    dx, dy = (ax0 + ax1 - bx0 - bx1) / 2, (ay0 + ay1 - by0 - by1) / 2
    return F.sqrt(dx * dx + dy * dy)


# ---- candidates


def _cells(boxes: DataFrame, cell: float, grow: float) -> DataFrame:
    """``boxes`` once for every grid cell that the box, grown on all sides, covers."""
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - grow) / cell), F.floor((F.col(hi) + grow) / cell))
    return boxes.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))


def near_pairs(a: DataFrame, b: DataFrame, on: list[str], *, within: float = 0.0, cell: float = 250.0) -> DataFrame:
    """Pairs of boxes of ``a`` and ``b`` with equal ``on`` that overlap or lie within a distance.

    Columns other than ``on`` are prefixed a_ and b_. A pair is kept only in
    the first cell that both cover, so it comes out once.
    """
    left, right = _cells(a, cell, within), _cells(b, cell, 0.0)
    left = left.select(*on, "gx", "gy", *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in on])
    right = right.select(*on, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in on])
    first_x = F.greatest(F.floor((F.col("a_x0") - within) / cell), F.floor(F.col("b_x0") / cell))
    first_y = F.greatest(F.floor((F.col("a_y0") - within) / cell), F.floor(F.col("b_y0") / cell))
    # Boxes are small in their files and large as a table of the driver: they meet by shuffles whatever the session broadcasts.
    met = left.join(right.hint("merge"), [*on, "gx", "gy"]).where((F.col("gx") == first_x) & (F.col("gy") == first_y))
    return met.where(gap("a_", "b_") <= within).drop("gx", "gy")


# ---- J01: one-to-one matches


def mutual_best(pairs: DataFrame, group: list[str], left: str, right: str, score: str, most_rounds: int = 50) -> DataFrame:
    """The greedy one-to-one choice by falling score, then left and right id.

    Every round accepts the pairs that are best for both their ends and drops
    what they use; it stops when no pair is left. Fails loudly past
    ``most_rounds``. A round reads and writes only the pairs still open.
    """
    taken: DataFrame | None = None
    open_pairs = written(pairs, "pairs")
    for _ in range(most_rounds):
        order = [F.desc(score), F.col(left), F.col(right)]
        ranked = open_pairs.withColumn("_l", F.row_number().over(Window.partitionBy(*group, left).orderBy(*order)))
        ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*group, right).orderBy(*order)))
        marked = written(ranked.withColumn("_best", (F.col("_l") == 1) & (F.col("_r") == 1)).drop("_l", "_r"), "round")
        best = marked.where("_best").drop("_best")
        taken = best if taken is None else taken.unionByName(best)
        rest = marked.where("not _best").drop("_best")
        rest = rest.join(best.select(*group, left), [*group, left], "left_anti").join(best.select(*group, right), [*group, right], "left_anti")
        open_pairs = written(rest.select(*pairs.columns), "pairs")
        if open_pairs.isEmpty():
            return taken.select(*pairs.columns)
    raise RuntimeError(f"matching did not end in {most_rounds} rounds")


def match(preds: DataFrame, keys: DataFrame, on: list[str], run: list[str], *, need_class: bool, threshold: float) -> DataFrame:
    """Predicted boxes matched to key boxes by overlap: run columns, on, pred_id, key_id, iou."""
    candidates = near_pairs(preds, keys, on).withColumn("iou", iou("a_", "b_")).where(F.col("iou") >= threshold)
    if need_class:
        candidates = candidates.where("a_class = b_class")
    own = candidates.select(*[F.col(f"a_{c}").alias(c) for c in run], *on, F.col("a_id").alias("pred_id"), F.col("b_id").alias("key_id"), "iou")
    return mutual_best(own, [*run, *on], "pred_id", "key_id", "iou")


# ---- J20, W09: agreement between runs


def agreement(preds: DataFrame, run: str = "tool", on: str = "sheet", least_iou: float = 0.1, double_iou: float = 0.5) -> DataFrame:
    """For each box the share of the other runs without an overlapping box of its class, and whether its own run holds it twice.

    Without another run on the sheet the share is one half.
    """
    pairs = near_pairs(preds, preds, [on]).withColumn("iou", iou("a_", "b_"))
    same_run = F.col(f"a_{run}") == F.col(f"b_{run}")
    met = pairs.where(~same_run & (F.col("a_class") == F.col("b_class")) & (F.col("iou") >= least_iou))
    found = met.groupBy(on, F.col(f"a_{run}").alias(run), F.col("a_id").alias("id")).agg(F.count_distinct(f"b_{run}").alias("found"))
    twice = pairs.where(same_run & (F.col("a_id") != F.col("b_id")) & (F.col("iou") >= double_iou)).select(on, F.col(f"a_{run}").alias(run), F.col("a_id").alias("id"), F.lit(True).alias("dup_box")).distinct()
    runs = preds.groupBy(on).agg((F.count_distinct(run) - 1).alias("others"))
    out = preds.join(runs.hint("merge"), on).join(found.hint("merge"), [on, run, "id"], "left").join(twice.hint("merge"), [on, run, "id"], "left")
    miss = F.when(F.col("others") == 0, F.lit(0.5)).otherwise(1 - F.coalesce("found", F.lit(0)) / F.col("others"))
    return out.select(run, on, "id", miss.alias("xm_miss"), F.coalesce("dup_box", F.lit(False)).alias("dup_box"))


def confidence_rank(preds: DataFrame, run: list[str]) -> DataFrame:
    """Share of the run's rated boxes with strictly higher confidence; one half without one."""
    own = Window.partitionBy(*run)
    place = F.rank().over(own.orderBy(F.desc_nulls_last("confidence"))) - 1
    return preds.withColumn("conf_rank", F.when(F.col("confidence").isNull(), F.lit(0.5)).otherwise(place / F.count("confidence").over(own)))


# ---- J10, J26: nearest boxes


def nearest_box(a: DataFrame, b: DataFrame, on: list[str], within: float) -> DataFrame:
    """For each box of ``a`` the nearest other box of ``b`` by gap, then id; within a distance."""
    pairs = near_pairs(a, b, on, within=within).where("a_id <> b_id").withColumn("gap", gap("a_", "b_"))
    return pairs.groupBy(*on, F.col("a_id").alias("id")).agg(F.min(F.struct("gap", F.col("b_id").alias("other"))).alias("m")).select(*on, "id", F.col("m.other").alias("nearest"), F.col("m.gap").alias("gap"))


def item_roles(symbols: DataFrame, on: list[str], within: float) -> DataFrame:
    """An instrument next to a valve, aligned with it and narrower, is its actuator."""
    valves, others = symbols.where("class = 'valve'"), symbols.where("class = 'instrument'")
    pairs = near_pairs(others, valves, on, within=within).withColumn("gap", gap("a_", "b_"))
    aligned = F.abs((F.col("a_x0") + F.col("a_x1") - F.col("b_x0") - F.col("b_x1")) / 2) <= (F.col("b_x1") - F.col("b_x0")) / 2
    narrow = (F.col("a_x1") - F.col("a_x0")) <= (F.col("b_x1") - F.col("b_x0"))
    best = pairs.where(aligned & narrow).groupBy(*on, F.col("a_id").alias("id")).agg(F.min(F.struct("gap", F.col("b_id").alias("valve"))).alias("m"))
    return best.select(*on, "id", F.col("m.valve").alias("valve"), F.lit("actuator").alias("role"))


def match_points(pred: DataFrame, truth: DataFrame, on: list[str], within: float) -> DataFrame:
    """Points matched one to one, nearest first, within a distance."""
    as_box = lambda p: p.select(*on, "id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pairs = near_pairs(as_box(pred), as_box(truth), on, within=within)
    own = pairs.select(*on, F.col("a_id").alias("pred_id"), F.col("b_id").alias("key_id"), (-gap("a_", "b_")).alias("nearness"))
    return mutual_best(own, on, "pred_id", "key_id", "nearness")


# ---- J28, J29: tiles


def to_sheet(preds: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes of tiles brought to sheet coordinates: ``tiles(sheet, tile, left, top, scale)``."""
    joined = preds.join(tiles, ["sheet", "tile"])
    return joined.select(*[c for c in preds.columns if c not in BOX], *[(F.col(c) * F.col("scale") + F.col("left" if c[0] == "x" else "top")).alias(c) for c in BOX])


def transferred_links(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Links of a second view whose both ends are paired, in the first view's ids; ``pairs(pred_id, key_id)``."""
    one = pairs.select(F.col("pred_id").alias("a"), F.col("key_id").alias("to_a"))
    two = pairs.select(F.col("pred_id").alias("b"), F.col("key_id").alias("to_b"))
    return links.join(one, "a").join(two, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct()
