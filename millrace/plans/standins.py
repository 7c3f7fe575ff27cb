"""How the given tables stand in for plant records, in Spark and as SQL.

readings   events: a run is a group of 15 users, the tag is the event type, and
           every 97th event is a bad sample.
keys       part: a symbol of a sheet (40 parts a sheet) with class and box.
preds      the same boxes moved by a rule; every 11th is missing, every 13th has
           another class, and two tools differ in the rule.
links      each part and the one that follows it in its first order.
items      part as equipment items, 16 a unit and 40 a sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.series import numbered

    own = table(spark, sf_dir, "events").select(
        "event_id",
        F.floor(F.col("user_id") / 15).cast("long").alias("run"),
        F.col("event_type").alias("tag"),
        "ts",
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"),
    )
    return numbered(own, "ts", "event_id").withColumn("row_no", F.col("row_no").cast("long"))


READINGS = """
readings AS (
  SELECT event_id, run, tag, ts, value, row_number() OVER (PARTITION BY run, tag ORDER BY ts, event_id) - 1 AS row_no
  FROM (SELECT event_id, floor(user_id / 15)::BIGINT AS run, event_type AS tag, ts, CASE WHEN event_id % 97 <> 0 THEN value END AS value FROM events)),
parts AS (
  SELECT *, CASE WHEN row_no < floor(count(*) OVER (PARTITION BY run, tag) / 2) THEN 'fit' ELSE 'held' END AS part FROM readings),
stats AS (
  SELECT run, tag, avg(value) AS mean, stddev_pop(value) AS sd, count(value) AS fit_good, count(*) - count(value) AS fit_bad
  FROM parts WHERE part = 'fit' GROUP BY run, tag HAVING count(value) > 0),
bands AS (
  SELECT *, mean - 3 * CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS lo, mean + 3 * CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS hi FROM stats),
flags AS (
  SELECT p.*, coalesce(p.value < b.lo OR p.value > b.hi, false) AS flag FROM parts p LEFT JOIN bands b USING (run, tag)),
low AS (
  SELECT p.*, coalesce(p.value < b.mean - 0.3 * b.sd OR p.value > b.mean + 0.3 * b.sd, false) AS flag FROM parts p LEFT JOIN bands b USING (run, tag))
"""

CLASSES = ("pump", "tank", "valve", "instrument", "line")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_partkey") % 40
    x, y = (n % 8) * 120 + (k * 7) % 31, F.floor(n / 8) * 180 + (k * 11) % 53
    return table(spark, sf_dir, "part").select(
        F.floor(k / 40).cast("long").alias("sheet"),
        k.alias("id"),
        F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("p_size") % 5 + 1).cast("int")).alias("class"),
        x.cast("double").alias("x0"),
        y.cast("double").alias("y0"),
        (x + 40 + F.col("p_size")).cast("double").alias("x1"),
        (y + 50 + F.col("p_size") % 13).cast("double").alias("y1"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = keys(spark, sf_dir).withColumn("tool", F.explode(F.array(F.lit(0), F.lit(1))))
    k, t = F.col("id"), F.col("tool")
    move = (k * (3 + t)) % 17
    return own.where((k + t) % 11 != 0).select(
        "tool", "sheet", "id",
        F.when((k + t) % 13 == 0, F.lit("general")).otherwise(F.col("class")).alias("class"),
        (F.col("x0") + move).alias("x0"), (F.col("y0") - move).alias("y0"), (F.col("x1") + move).alias("x1"), (F.col("y1") - move).alias("y1"),
        F.when((k * 7 + t) % 19 != 0, ((k * 37 + t * 11) % 100) / 100.0).alias("confidence"),
    )


BOXES = """
keys AS (
  SELECT floor(k / 40)::BIGINT AS sheet, k AS id, class, x::DOUBLE AS x0, y::DOUBLE AS y0, (x + 40 + p_size)::DOUBLE AS x1, (y + 50 + p_size % 13)::DOUBLE AS y1
  FROM (SELECT p_partkey AS k, p_size, (['pump', 'tank', 'valve', 'instrument', 'line'])[p_size % 5 + 1] AS class,
    ((p_partkey % 40) % 8) * 120 + (p_partkey * 7) % 31 AS x, floor((p_partkey % 40) / 8)::BIGINT * 180 + (p_partkey * 11) % 53 AS y FROM part)),
preds AS (
  SELECT tool, sheet, id, CASE WHEN (id + tool) % 13 = 0 THEN 'general' ELSE class END AS class,
    x0 + m AS x0, y0 - m AS y0, x1 + m AS x1, y1 - m AS y1, CASE WHEN (id * 7 + tool) % 19 <> 0 THEN ((id * 37 + tool * 11) % 100) / 100.0 END::DOUBLE AS confidence
  FROM (SELECT k.*, tool, (id * (3 + tool)) % 17 AS m FROM keys k, (VALUES (0), (1)) AS t(tool)) WHERE (id + tool) % 11 <> 0),
pairs AS (
  SELECT p.tool, p.sheet, p.id AS pred_id, k.id AS key_id, p.class AS pred_class, k.class AS key_class,
    greatest(0, least(p.x1, k.x1) - greatest(p.x0, k.x0)) * greatest(0, least(p.y1, k.y1) - greatest(p.y0, k.y0)) AS inter,
    (p.x1 - p.x0) * (p.y1 - p.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) AS areas
  FROM preds p JOIN keys k ON p.sheet = k.sheet),
scored AS (SELECT *, CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0 END AS iou FROM pairs)
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges over all parts: each part and the one that follows it in the first order that has one.

    Like the connections of drawings these are about as many as nodes.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lead("l_partkey").over(order).alias("other"))
    first = own.where("other is not null and other <> l_partkey").groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "other")).alias("m"))
    return first.select(F.least("l_partkey", "m.other").alias("a"), F.greatest("l_partkey", "m.other").alias("b")).distinct()


LINKS = """
links AS (
  SELECT DISTINCT least(p, o) AS a, greatest(p, o) AS b
  FROM (SELECT p, o, row_number() OVER (PARTITION BY p ORDER BY l_orderkey, l_linenumber, l_suppkey, o) AS k
    FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o FROM lineitem)
    WHERE o IS NOT NULL AND o <> p) WHERE k = 1)
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items: id, tag, kind, unit, sheet, size, price."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.element_at(F.array(*map(F.lit, ("FIC", "TI", "PSV", "LAHH", "XV"))), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("-"), (F.col("p_partkey") % 700).cast("string")).alias("tag"),
        F.lower("p_type").alias("kind"),
        F.floor(F.col("p_partkey") / 16).cast("long").alias("unit"),
        F.floor(F.col("p_partkey") / 40).cast("long").alias("sheet"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


ITEMS = """
items AS (
  SELECT p_partkey AS id, (['FIC', 'TI', 'PSV', 'LAHH', 'XV'])[p_partkey % 5 + 1] || '-' || (p_partkey % 700) AS tag, lower(p_type) AS kind,
    p_partkey // 16 AS unit, floor(p_partkey / 40)::BIGINT AS sheet, p_size AS size, p_retailprice AS price FROM part)
"""
