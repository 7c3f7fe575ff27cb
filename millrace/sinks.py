"""Sinks: wide historian CSV, sheets, registers and graph exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.order import numbered as placed
from millrace.scratch import written


def wide_csv(readings: DataFrame, tags: list[str], path: str, most_rows: int | None = None) -> None:
    """``readings(run, row_no, tag, value)`` as CSV files of a row a time and a column a tag, in a folder per run.

    A run's rows stay in order in one file; runs spread over tasks.
    """
    own = readings if most_rows is None else readings.where(F.col("row_no") < most_rows)
    wide = own.groupBy("run", "row_no").pivot("tag", tags).agg(F.first("value"))
    wide.repartition("run").sortWithinPartitions("run", "row_no").write.option("header", True).partitionBy("run").csv(path)


def sheet(rows: DataFrame, columns: list[str], path: str) -> None:
    """The stated columns in the stated order, with a header."""
    rows.select(*columns).write.option("header", True).csv(path)


GRAPH = ("nodes", "edges", "claims", "events", "not_exported")


def graph(nodes: DataFrame, edges: DataFrame, claims: DataFrame, events: DataFrame, path: str) -> None:
    """The portable graph as Parquet, a folder for each kind of record.

    ``nodes(id, type, label, status)``; ``edges(section, item, id, type, from,
    to, status)``, of which one without an id gets ``E`` and its place among
    all of them, in the order of section and item; ``claims(item, name, value,
    source)`` and ``events(item, decision, by, on)`` of nodes. Edges to unknown
    nodes, nodes whose id repeats (all but the first by type and label), and
    claims and events of unknown items are not exported but listed with the
    reason.
    """
    order = Window.partitionBy("id").orderBy("type", "label")
    rated = nodes.withColumn("_k", F.row_number().over(order))
    known = written(rated.where("_k = 1 and id is not null").select("id", "type", "label", "status"), "nodes")
    ids = known.select("id")
    sides = edges.join(ids.select(F.col("id").alias("from"), F.lit(True).alias("_a")), "from", "left").join(ids.select(F.col("id").alias("to"), F.lit(True).alias("_b")), "to", "left")
    numbered = placed(sides.withColumn("_at", F.struct("section", "item")), "_at", "_n")
    checked = written(numbered.withColumn("id", F.coalesce("id", F.format_string("E%05d", F.col("_n") + 1))), "edges")
    whole = checked.where("_a and _b").select("id", "type", "from", "to", "status")
    of = lambda df: df.join(ids.select(F.col("id").alias("item")), "item", "left_semi")
    lost = lambda df, kind: df.join(ids.select(F.col("id").alias("item")), "item", "left_anti").select(F.lit(kind).alias("kind"), F.col("item").alias("id"), F.lit("its item is not in the graph").alias("why"))
    left_out = (
        rated.where("_k > 1 or id is null").select(F.lit("node").alias("kind"), "id", F.when(F.col("id").isNull(), "no id").otherwise("the id repeats").alias("why"))
        .unionByName(checked.where("_a is null or _b is null").select(F.lit("edge").alias("kind"), "id", F.lit("an end is not in the graph").alias("why")))
        .unionByName(lost(claims, "claim"))
        .unionByName(lost(events, "event"))
    )
    for name, df in zip(GRAPH, (known, whole, of(claims), of(events), left_out), strict=True):
        df.write.parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The records of a graph that ``graph`` wrote."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in GRAPH}


def documents(rows: DataFrame, path: str) -> None:
    """Nested rows as JSON lines."""
    rows.write.json(path)
