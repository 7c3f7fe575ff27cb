"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import written


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs(node, other)`` with ``least``, the smallest of node and its others; partial minima are taken before the shuffle."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least")).select(F.col("node").alias("of"), F.least("node", "least").alias("least"))
    return pairs.join(least, F.col("node") == F.col("of")).select("node", "other", "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    out = _with_least(both).where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    starred = _with_least(down)
    out = starred.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(starred.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node of its component.

    Each round halves the depth of what is left, so chains of n nodes take
    about log n rounds. Rounds end when both steps leave the edges as they
    were; each round is written to the shared folder.
    """
    now = edges.where("a <> b")
    seen = None
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).collect()[0]
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
