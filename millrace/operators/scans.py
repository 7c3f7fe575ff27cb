"""Scans over long series, a chunk of rows at a time.

A series is cut into chunks by a number that its rows have (row number or
time). What a chunk needs of the others is small: the last or first rows of
the chunks beside it, or the latest event before it. These come from a table
with a row a chunk, so no window and no task runs over a series itself, and
the result is the same whatever the chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
#: Microseconds of a chunk of time.
SPELL = 3_600_000_000
OWN, AT, PLACE = "_own", "_chunk", "_place"


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same ``keys``, null keys being equal; columns of ``right`` other than keys are added."""
    named = right.select(*[F.col(k).alias(f"_of{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    return left.join(named, same).drop(*[f"_of{k}" for k in keys])


def by_rows(at: str = "row_no", chunk: int = CHUNK) -> Column:
    return F.floor(F.col(at) / chunk).cast("long")


def with_neighbours(rows: DataFrame, keys: list[str], order: list[str], chunk: Column, before: int, after: int = 0) -> DataFrame:
    """``rows`` with ``_chunk``, and in each chunk copies of the ``before`` rows before it and the ``after`` rows behind it, ``_own`` false.

    ``chunk`` must not fall as ``order`` rises. A window over (keys, _chunk) in
    that order then sees the rows around each own row as one over the whole
    series would.
    """
    cut = rows.withColumn(AT, chunk)
    item = F.struct(*[F.col(c) for c in rows.columns])
    place = [F.col(c) for c in order]
    inside = Window.partitionBy(*keys, AT)
    out = cut.withColumn(OWN, F.lit(True))
    for count, forward in ((before, True), (after, False)):
        if not count:
            continue
        near = F.row_number().over(inside.orderBy(*([c.desc() for c in place] if forward else place)))
        kept = cut.withColumn("_near", near).where(F.col("_near") <= count).groupBy(*keys, AT).agg(F.collect_list(F.struct("_near", item.alias("row"))).alias("_held"))
        # The nearest chunks hold a row each at least, so as many of them as rows are enough.
        span = Window.partitionBy(*keys).orderBy(AT)
        span = span.rowsBetween(-count, -1) if forward else span.rowsBetween(1, count)
        far = F.flatten(F.collect_list(F.transform("_held", lambda x: F.struct(F.when(F.lit(forward), -F.col(AT)).otherwise(F.col(AT)).alias("c"), x["_near"].alias("k"), x["row"].alias("row")))).over(span))
        nearest = F.slice(F.array_sort(far, lambda x, y: F.when(x["c"] < y["c"], -1).when(x["c"] > y["c"], 1).when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0)), 1, count)
        sent = kept.withColumn("_sent", nearest).select(F.col(AT).alias("_to"), F.explode("_sent").alias("x"))
        out = out.unionByName(sent.select("x.row.*", F.col("_to").alias(AT), F.lit(False).alias(OWN)))
    return out


def inside(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, AT).orderBy(*order)


def latest(marked: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``(keys, _chunk, name)``: the greatest ``value`` in the chunks before each; null where there is none."""
    per = marked.groupBy(*keys, AT).agg(F.max(value).alias("_most"))
    earlier = Window.partitionBy(*keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, AT, F.max("_most").over(earlier).alias(name))


def runs(rows: DataFrame, keys: list[str], at: str, begins: Column, chunk: Column, sums: list[Column], again: list[Column]) -> DataFrame:
    """Unbroken runs: a run goes from a row where ``begins`` to the next such row.

    ``begins`` may look one row back in a window of ``inside``. A run is summed
    in each chunk by ``sums`` and over its chunks by ``again``; it is named by
    ``at`` of its first row, ``_run``.
    """
    near = with_neighbours(rows, keys, [at], chunk, 1)
    marked = near.withColumn("_begins", begins).where(OWN)
    first = F.max(F.when(F.col("_begins"), F.col(at))).over(inside(keys, [at]))
    parts = marked.withColumn("_first", first).groupBy(*keys, AT, "_first").agg(*sums)
    before = latest(parts, keys, F.col("_first"), "_open")
    joined = beside(parts, before, [*keys, AT]).withColumn("_run", F.coalesce("_first", "_open"))
    return joined.groupBy(*keys, "_run").agg(*again)


def numbered(rows: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 0 in each series in the order of ``by``, nulls first: rows are counted by chunks of the first, then numbered in their chunk."""
    kind = rows.schema[by[0]].dataType.simpleString()
    lead = F.col(by[0])
    if kind.startswith("timestamp"):
        chunk = F.floor(F.unix_micros(lead.cast("timestamp")) / SPELL)
    elif kind in ("date", "string", "boolean"):
        raise ValueError(f"{by[0]} is a {kind}: number by a time or a number")
    else:
        chunk = F.floor(lead / CHUNK)
    cut = rows.withColumn(AT, F.coalesce(chunk.cast("long"), F.lit(-(1 << 62)).cast("long")))
    earlier = Window.partitionBy(*keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, AT).agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, AT, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(inside(keys, by)) - 1
    return beside(cut, starts, [*keys, AT]).withColumn(name, (F.col("_start") + place).cast("long")).select(*rows.columns, name)


def by_chunks(rows: DataFrame, keys: list[str], order: str, work: Callable[[pa.Table], pa.RecordBatch], schema: str, send: int = 1 << 16) -> DataFrame:
    """``work`` on the rows of each ``keys`` in ``order``.

    Rows are numbered in each key by a window and cut where a number is 1, so
    thousands of short series cost what one long one does; a task holds an
    Arrow batch and the rows of the key it has begun. The window also keeps
    the rows of a key in one partition: a mere ``repartition`` is dropped by
    Spark after a join on the same keys, and the join's shuffle may then be
    read by its map tasks once its other side proves small enough to broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            cuts = [*np.flatnonzero(batch.column(PLACE).to_numpy() == 1).tolist(), len(batch)]
            if held and cuts[0] > 0:
                held.append(batch.slice(0, cuts[0]))
            for a, b in zip(cuts, cuts[1:]):
                if held:
                    made.append(work(pa.Table.from_batches(held)))
                    size += len(made[-1])
                held = [batch.slice(a, b - a)]
            if size >= send:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made, size = [], 0
        if held:
            made.append(work(pa.Table.from_batches(held)))
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn(PLACE, place).sortWithinPartitions(*keys, PLACE).mapInArrow(run, schema)
