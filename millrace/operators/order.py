"""Numbering of whole tables without a task that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import written


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of ``by``, null last.

    Rows are dealt to ranges, ranges are counted, and a row's number is that
    of its range's start and its place inside.
    """
    order = F.col(by).asc_nulls_last()
    dealt = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")
