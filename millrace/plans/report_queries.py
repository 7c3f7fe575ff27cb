"""Queries over layers, metrics, item sections and written sheets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import pipes as P
from millrace.operators import scoring as S
from millrace.plans.record_queries import CATALOG
from millrace.plans.scoring_queries import COUNTS, _counts
from millrace.plans.standins import LINKS, items, links, table
from millrace.scratch import new_path
from millrace.sources import records as R


def a07(spark: SparkSession, d: str) -> DataFrame:
    """Pipe layers of the links against a tracing of them, by sheet and over all sheets.

    Every third size is a junction; the tracing numbers junctions anew, misses
    some lines, takes some for the other layer, and some junctions for another
    kind.
    """
    sheet = lambda c: F.floor(F.col(c) / 40).cast("long").alias("sheet")
    truth = links(spark, d).select(sheet("a"), F.when((F.col("a") + F.col("b")) % 4 == 0, "instrument").otherwise("pipe").alias("layer"), "a", "b")
    junctions = table(spark, d, "part").where("p_size % 3 = 0").select(sheet("p_partkey"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "pipe_tee").otherwise("instrument_tap").alias("kind"))
    # A line may end on a junction of another sheet: each sheet knows all junctions that its lines end on.
    ends = truth.select("sheet", F.explode(F.array("a", "b")).alias("id")).distinct().join(junctions.select("id", "kind"), "id").select("sheet", "id", "kind")
    traced = F.col("id") + 1_000_000_000
    pj = ends.where("id % 13 <> 0").select("sheet", traced.alias("id"), F.when(F.col("id") % 11 == 0, "pipe_tee").otherwise(F.col("kind")).alias("kind"))
    match = ends.where("id % 13 <> 0 and id % 17 <> 0").select("sheet", traced.alias("pred"), F.col("id").alias("truth"))
    is_j = ends.where("id % 13 <> 0")
    given = truth.where("(a * 3 + b) % 7 <> 0").withColumn("layer", F.when(F.col("a") % 11 == 0, "pipe").otherwise(F.col("layer")))
    for end in ("a", "b"):
        given = given.join(is_j.select("sheet", F.col("id").alias(end), F.lit(1_000_000_000).alias("by")), ["sheet", end], "left").withColumn(end, F.col(end) + F.coalesce("by", F.lit(0))).drop("by")
    return P.pipe_score(given, truth, pj, ends, match)


def x01(spark: SparkSession, d: str) -> DataFrame:
    """The catalog itself: what each question asks of which fields, checked against the items that hold them."""
    rows = [(q["id"], kind, key) for q in CATALOG for kind, sels in (("anchor", [q["anchor"]]), ("with", [c["match"] for c in q.get("with", [])]), ("without", [c["match"] for c in q.get("without", [])])) for sel in sels for key in sel]
    asked = spark.createDataFrame(rows, "question string, clause string, test string").withColumn("field", F.when(F.col("test").rlike("text"), "tag").otherwise(F.regexp_replace("test", "_(min|max)$", "")))
    held = items(spark, d).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("ok")) for c in ("tag", "unit", "price", "size")])).alias("f")).groupBy("f.field").agg(F.count_if("f.ok").alias("items"))
    return asked.join(F.broadcast(held), "field", "left").select("question", "clause", "test", "field", "items")


def x02(spark: SparkSession, d: str) -> DataFrame:
    """Every metric of the metric table, per tool."""
    return _counts(spark, d).groupBy("tool").agg(*[f().alias(name) for name, f in S.METRICS.items()])


def s11(spark: SparkSession, d: str) -> DataFrame:
    """Models with sections become one item relation."""
    record = lambda i, t: F.struct(i.cast("string").alias("id"), t.alias("tag"))
    units = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg(F.to_json(F.collect_list(record(F.col("s_suppkey"), F.col("s_name")))).alias("units"))  # a model's units
    lines = table(spark, d, "nation").select(F.col("n_nationkey").alias("file"), F.to_json(F.array(record(F.col("n_regionkey"), F.col("n_name")))).alias("streams"))
    flat = R.flat_items(units.join(lines, "file", "full"), {"units": "unit", "streams": "stream", "valves": "valve"})
    return flat.groupBy("file", "kind").agg(F.count("*").alias("n"), F.min("tag").alias("first_tag"))


def k06(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with stated columns, written and read back."""
    path = new_path(spark, "sheet")
    own = table(spark, d, "supplier").withColumn("note", F.concat(F.lit('say "'), "s_name", F.lit('", ok')))
    sinks.sheet(own, ["note", "s_suppkey", "s_acctbal"], path)
    return spark.read.option("header", True).option("escape", "\\").schema("note string, s_suppkey long, s_acctbal double").csv(path)


QUERIES = {
    "a07_pipe_layers": (a07, "WITH " + LINKS + """, t AS (SELECT floor(a / 40)::BIGINT AS sheet, CASE WHEN (a + b) % 4 = 0 THEN 'instrument' ELSE 'pipe' END AS layer, a, b FROM links),
      jn AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'pipe_tee' ELSE 'instrument_tap' END AS kind FROM part WHERE p_size % 3 = 0),
      j AS (SELECT DISTINCT sheet, id, kind FROM (SELECT sheet, unnest([a, b]) AS id FROM t) JOIN jn USING (id)),
      g AS (SELECT sheet, CASE WHEN a % 11 = 0 THEN 'pipe' ELSE layer END AS layer, a, b FROM t WHERE (a * 3 + b) % 7 <> 0),
      f AS (SELECT g.*, x.id IS NOT NULL AS ja, y.id IS NOT NULL AS jb FROM g LEFT JOIN j x ON x.sheet = g.sheet AND x.id = g.a LEFT JOIN j y ON y.sheet = g.sheet AND y.id = g.b),
      h AS (SELECT t.*, x.id IS NOT NULL AS ja, y.id IS NOT NULL AS jb FROM t LEFT JOIN j x ON x.sheet = t.sheet AND x.id = t.a LEFT JOIN j y ON y.sheet = t.sheet AND y.id = t.b),
      r AS (
        SELECT sheet, layer, 0 AS tp, 1 AS predicted, 0 AS truth FROM f
        UNION ALL SELECT f.sheet, f.layer, 1, 0, 0 FROM f JOIN t ON t.sheet = f.sheet AND t.layer = f.layer AND t.a = f.a AND t.b = f.b
          WHERE (NOT ja OR (f.a % 17 <> 0 AND f.a % 13 <> 0)) AND (NOT jb OR (f.b % 17 <> 0 AND f.b % 13 <> 0)) OR (ja AND f.a % 13 = 0 AND (NOT jb OR f.b % 13 = 0 OR f.b % 17 <> 0)) OR (jb AND f.b % 13 = 0 AND (NOT ja OR f.a % 13 = 0 OR f.a % 17 <> 0))
        UNION ALL SELECT sheet, layer, 0, 0, 1 FROM t
        UNION ALL SELECT sheet, 'item_to_item', 0, 1, 0 FROM f WHERE layer = 'pipe' AND (NOT ja OR a % 13 = 0) AND (NOT jb OR b % 13 = 0)
        UNION ALL SELECT sheet, 'item_to_item', 0, 0, 1 FROM h WHERE layer = 'pipe' AND NOT ja AND NOT jb
        UNION ALL SELECT f.sheet, 'item_to_item', 1, 0, 0 FROM f JOIN h ON h.sheet = f.sheet AND h.a = f.a AND h.b = f.b WHERE f.layer = 'pipe' AND h.layer = 'pipe' AND NOT f.ja AND NOT f.jb
        UNION ALL SELECT sheet, 'junctions', (id % 13 <> 0 AND id % 17 <> 0)::INT, (id % 13 <> 0)::INT, 1 FROM j
        UNION ALL SELECT sheet, 'junction_kinds', (id % 11 <> 0 OR kind = 'pipe_tee')::INT, 1, 1 FROM j WHERE id % 13 <> 0 AND id % 17 <> 0),
      c AS (SELECT sheet, layer, sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(truth)::BIGINT AS truth FROM r GROUP BY GROUPING SETS ((sheet, layer), (layer)))
      SELECT *, CASE WHEN predicted > 0 THEN round(tp / predicted, 3) ELSE 0 END::DOUBLE AS precision, CASE WHEN truth > 0 THEN round(tp / truth, 3) ELSE 0 END::DOUBLE AS recall, CASE WHEN predicted + truth > 0 THEN round(2.0 * tp / (predicted + truth), 3) ELSE 0 END::DOUBLE AS f1 FROM c"""),
    "x01_question_catalog": (x01, """SELECT question, clause, test, field, (SELECT count(*) FROM part) AS items FROM (VALUES ('q1', 'anchor', 'text', 'tag'), ('q1', 'with', 'text', 'tag'), ('q1', 'without', 'text', 'tag'), ('q1', 'without', 'size_min', 'size'),
      ('q2', 'anchor', 'text', 'tag'), ('q2', 'anchor', 'price_min', 'price'), ('q2', 'with', 'text', 'tag'), ('q2', 'with', 'size_max', 'size')) AS c(question, clause, test, field)"""),
    "x02_metric_table": (x02, COUNTS + """SELECT tool, (2.0 * sum(tp) / (sum(predicted) + sum(in_key)))::DOUBLE AS f1, sum(tp) / sum(in_key) AS recall, (100.0 * (sum(predicted) + sum(in_key) - 2 * sum(tp)) / sum(in_key))::DOUBLE AS review_load FROM counts GROUP BY tool"""),
    "s11_item_sections": (s11, """SELECT s_nationkey AS file, 'unit' AS kind, count(*) AS n, min(s_name) AS first_tag FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey, 'stream', 1, n_name FROM nation"""),
    "k06_sheet": (k06, """SELECT 'say "' || s_name || '", ok' AS note, s_suppkey, s_acctbal FROM supplier"""),
}
