"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight (its share of the whole mix) and a schedule: how
strongly it is drawn in each phase of training. Integrated over the phases,
the schedule is the source's cumulative demand; the sum over all sources is
the cumulative demand of the stream, in words. The word at offset ``c`` of a
source's own stream is demanded when the source's cumulative demand reaches
``c``; the stream's cumulative demand at that time is its training position.
At every position the sources' shares thus add up to one. Documents are
range-sorted by position, each pass over a document at a position of its own.

Offsets come from a two-level prefix sum: sums by (source, hash bucket), a
running sum over buckets, and a running sum inside each bucket. A source that
holds a third of all rows is split over all buckets. Sources are numbered and
levelled without gathering them in one task, so they may be many.

Defined cases: null text has size 0; null source is a source of its own and
comes last; size 0 takes nothing and has no position; documents with equal
ids are told apart by size; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import free_name
from millrace.scratch import written

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5.0, 2.0, 1.0)
#: How strongly a source is drawn in each phase of training, by its place in the cycle.
PHASES = ((3.0, 2.0, 1.0), (1.0, 1.0, 1.0), (1.0, 2.0, 3.0))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of ``column``, null last: counts of ranges, then a number inside each."""
    order = F.col(column).asc_nulls_last()
    dealt = written(rows.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranges")
    # A row per range, of which there are as many as shuffle partitions.
    starts = dealt.groupBy("range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return dealt.join(F.broadcast(starts), "range").withColumn(name, F.col("start") + inside - 1).drop("range", "start")


def level_of(caps: DataFrame) -> float:
    """The level at which ``least(cap, level * weight)`` adds up to all sizes of ``caps(source_size, weight, cap)``.

    The excess of capped sources is shared again by weight until no further
    source is capped; each round is one aggregate.
    """
    total, level, seen = caps.agg(F.sum("source_size")).first()[0] or 0, 0.0, None
    while total:
        over = F.col("cap") / F.col("weight") <= level
        now = caps.agg(F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if now == seen or not now[1]:
            break
        level, seen = float(total - now[0]) / now[1], now
    return level


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, max_repeat: int = 3) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source, source_no, source_size, weight, target.

    A source is filled to ``level * weight`` or to ``max_repeat`` times its size, whichever is less.
    """
    by_source = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source", "source_no")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("source_no") % len(cycle) + 1).cast("int"))
    caps = written(by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat), "sources")
    return caps.select("source", "source_no", "source_size", "weight", F.least(F.col("cap").cast("double"), F.lit(level_of(caps)) * F.col("weight")).alias("target"))


def cumulative(phases: tuple[tuple[float, ...], ...]) -> list[list[float]]:
    """Of each schedule, the share of its demand that is met when each phase begins, and 1.0."""
    return [[sum(row[:k]) / sum(row) for k in range(len(row))] + [1.0] for row in phases]


def stream_demand(plan: DataFrame, phases: tuple[tuple[float, ...], ...]) -> DataFrame:
    """One row: ``demand``, the words that all sources of ``plan(source_no, goal)`` demand before each phase, and in all."""
    met = cumulative(phases)
    share = lambda k: F.element_at(F.array(*[F.lit(row[k]) for row in met]), (F.col("source_no") % len(met) + 1).cast("int"))
    words_by = [F.coalesce(F.sum(F.floor(F.col("goal") * share(k))), F.lit(0)).cast("long") for k in range(len(met[0]))]
    return plan.agg(F.array(*words_by).alias("demand"))


def position_of(share: Column, source_no: Column, demand: Column, phases: tuple[tuple[float, ...], ...]) -> Column:
    """The stream's cumulative ``demand`` at the time when ``share`` of a source's own demand is met."""
    out = F.lit(None).cast("double")
    for no, met in enumerate(cumulative(phases)):
        inverse = None
        for k in reversed(range(len(met) - 1)):
            if met[k + 1] == met[k]:  # the source is not drawn in this phase
                continue
            part = (share - F.lit(met[k])) / F.lit(met[k + 1] - met[k])
            here = demand[k] + part * (demand[k + 1] - demand[k])
            inverse = here if inverse is None else F.when(share < F.lit(met[k + 1]), here).otherwise(inverse)
        out = F.when(source_no % len(phases) == no, inverse).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[float, ...] = CYCLE,
    phases: tuple[tuple[float, ...], ...] = PHASES,
    max_repeat: int = 3,
    bucket_rows: int = 1_000,
) -> DataFrame:
    """Return doc_id, source, size, source_size, target, taken, passes, position.

    ``taken`` counts words with repeats: the stream of a source repeats its
    documents in hash order until its target is met, so only the document at
    the end of the stream is taken in part. ``passes`` has a
    struct<pass, words, position> for each pass that takes the document;
    ``position``, in words from the start of training, is that of the first.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
        ),
        "sized",
    )
    buckets = max(1, -(-sized.count() // bucket_rows))
    place = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")
    dealt = sized.withColumn("bucket", place)
    sums = written(dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    plan = source_targets(sums.select("source", F.col("bucket_size").alias("size")), cycle, max_repeat).withColumn("goal", F.floor("target"))
    planned = written(plan.join(F.broadcast(stream_demand(plan, phases)), how="cross"), "plan")  # one row of demand
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    starts = starts.alias("a").join(planned.alias("p"), F.col("a.source").eqNullSafe(F.col("p.source"))).select("a.source", "bucket", "bucket_start", "source_no", "source_size", "target", "goal", "demand")
    joined = dealt.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    inside = Window.partitionBy("d.source", "d.bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    at = joined.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "source_no", "target", "goal", "demand", "h", start.alias("start"))

    def once(e: int) -> Column:
        begin = F.col("start") + F.col("source_size") * e
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - begin))
        share = begin.cast("double") / F.greatest(F.col("goal"), F.lit(1)).cast("double")
        return F.struct(F.lit(e).alias("pass"), taken.alias("words"), position_of(share, F.col("source_no"), F.col("demand"), phases).alias("position"))

    passes = at.withColumn("passes", F.filter(F.array(*map(once, range(max_repeat))), lambda x: x["words"] > 0))
    out = passes.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda n, x: n + x["words"])).withColumn("position", F.get("passes", F.lit(0))["position"])
    # The hash breaks ties, so the many documents without a position spread over ranges.
    return out.orderBy(F.col("position").asc_nulls_last(), "h", "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "position")


def stream(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a row for each of the ``passes`` of ``mixed(doc_id, passes)``, in its own columns, range-sorted by position.

    A null id and repeated ids take the passes of that among them which has most.
    """
    key, passes, one = (free_name(n, docs.columns) for n in ("key", "passes", "one"))
    most = F.max_by("passes", F.struct(F.size("passes"), F.get("passes", F.lit(0))["position"]))
    held = mixed.where(F.size("passes") > 0).groupBy(F.col("doc_id").alias(key)).agg(most.alias(passes))
    rows = docs.join(held, docs[id_col].eqNullSafe(held[key])).select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(passes).alias(one))
    return rows.orderBy(f"{one}.position", id_col, f"{one}.pass").drop(one)
