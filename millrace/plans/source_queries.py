"""Queries that write files from the given tables, read them back by the scans, and stream them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import graphs as G
from millrace.operators import series as S
from millrace.plans.series_queries import DRIFT
from millrace.plans.standins import READINGS, readings, table
from millrace.scratch import new_path, written
from millrace.sources import historian as H
from millrace.sources import records as R
from millrace.sources.streams import streams
from millrace.streaming import replay as T

TAGS = ["click", "error", "purchase", "signup", "view"]
WITH = "WITH " + READINGS


def s01(spark: SparkSession, d: str) -> DataFrame:
    """Runs of even and of odd number are written with their tags in opposite orders, and read by one scan."""
    path, own = new_path(spark, "wide"), readings(spark, d)
    sinks.wide_csv(own.where("run % 2 = 0"), TAGS, f"{path}/even")
    sinks.wide_csv(own.where("run % 2 = 1"), TAGS[::-1], f"{path}/odd")
    long = H.wide_csv(spark, f"{path}/*/*/*.csv")
    return long.groupBy("tag", "tag_pos").agg(F.count("value").alias("good"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("run").alias("runs"))


#: Elements of a written XML file at most (fixed): such a file is read whole by one task.
XML_ROWS = 50_000


def s01_findings(spark: SparkSession, d: str) -> DataFrame:
    """Files of 500 events: some rows lack a cell or a time, some files repeat a name or mix clocks."""
    path = new_path(spark, "faulty")
    e, k, f = table(spark, d, "events"), F.col("event_id"), F.floor(F.col("event_id") / 500)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + k), "yyyy-MM-dd'T'HH:mm:ss")
    time = F.when(k % 41 == 7, F.lit("soon")).when((f % 5 == 2) & (k % 2 == 0), F.concat(stamp, F.lit("Z"))).when(f % 5 == 2, stamp).otherwise((k - F.when(k % 67 == 3, 9).otherwise(0)).cast("string"))
    line = F.concat_ws(",", time, F.col("value").cast("string"), F.when(k % 29 != 5, F.lit('"a, ""b"""')))
    head = F.when(f % 7 == 3, "t,x,x").when(f % 11 == 4, "t,5,").otherwise("t,x,y")
    rows = e.select(f.alias("f"), k.alias("k"), line.alias("value")).unionByName(e.select(f.alias("f"), F.lit(-1).cast("long").alias("k"), head.alias("value")).distinct())
    rows.repartition("f").sortWithinPartitions("f", "k").select("value", "f").write.partitionBy("f").text(path)
    return H.wide_findings(spark, f"{path}/*/*.txt").groupBy("finding").agg(F.count("*").alias("n"), F.count_distinct("run").alias("files"))


def s01_order(spark: SparkSession, d: str) -> DataFrame:
    """Hours of events as times of a file of 1,000 events: rows that do not rise."""
    path = new_path(spark, "hours")
    rows = table(spark, d, "events").select(F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("t"), "value", "event_id", F.floor(F.col("event_id") / 1000).alias("f"))
    rows.repartition("f").sortWithinPartitions("f", "event_id").select("t", "value", "f").write.option("header", True).partitionBy("f").csv(path)
    return H.order_findings(H.wide_csv(spark, f"{path}/*/*.csv")).groupBy("finding").agg(F.count("*").alias("n"))


def s02(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "matrix")
    li = table(spark, d, "lineitem").select(F.concat_ws("   ", "l_quantity", "l_discount", "l_tax").alias("value"))
    li.write.text(path)
    return H.matrix(spark, path).groupBy("channel").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def s03(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "labelled")
    e = table(spark, d, "events").select("event_id", "value", F.when(F.col("event_id") % 1000 >= 700, 1.0).otherwise(0.0).alias("anomaly"), F.when(F.col("event_id") % 1000 == 650, 1.0).otherwise(0.0).alias("changepoint"), F.floor(F.col("event_id") / 1000).alias("f"))
    e.repartition("f").sortWithinPartitions("f", "event_id").write.option("header", True).option("sep", ";").partitionBy("f").csv(path)
    found = H.labelled_runs(spark, f"{path}/*/*.csv")
    return found.groupBy("rows", "first_anomaly", "first_changepoint").agg(F.count("*").alias("runs"))


def s04(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "gz")
    e = table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 50 >= 40).cast("int").alias("attack"), F.floor(F.col("event_id") / 1000).alias("f"))
    e.repartition("f").sortWithinPartitions("f", "event_id").write.option("header", True).option("compression", "gzip").partitionBy("f").csv(path)
    return H.label_events(spark, f"{path}/*/*.csv.gz", "attack").groupBy("first_row", "last_row", "samples").agg(F.count("*").alias("runs"))


def s05(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "cycles")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_quantity")), lambda x: x.cast("string")), "\t").alias("value")).select("value")
    li.write.text(path)
    return H.cycle_means(spark, path).agg(F.count("*").alias("cycles"), F.round(F.sum("mean"), 3).alias("total"))


def s06(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    spans = spark.createDataFrame([("a", "2024-01-05 00:00:00", "2024-01-07 00:00:00", "2024-01-06 00:00:00"), ("b", "2024-01-06 12:00:00", "2024-01-09 00:00:00", "2024-01-08 00:00:00")], "name string, a string, b string, fault string")
    own = spans.select("name", *[F.col(c).cast("timestamp").alias(c) for c in ("a", "b", "fault")])
    return H.windows(e.withColumn("ts", F.col("ts").cast("timestamp")), F.broadcast(own)).groupBy("name", "after_fault").agg(F.count("*").alias("n"))


def s07(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "comma")
    e = table(spark, d, "events").select(F.col("event_id").alias("ts"), F.regexp_replace(F.col("value").cast("string"), r"\.", ",").alias("v"))
    for name, c in (("a", "ts % 7 <> 0"), ("b", "ts % 5 <> 0")):
        e.where(c).write.option("header", True).option("sep", ";").csv(f"{path}/{name}")
    read = lambda n: spark.read.option("header", True).option("sep", ";").csv(f"{path}/{n}").select("ts", H.decimal_comma(F.col("v")).alias(n))
    whole, missing = H.joined_on_time([read("a"), read("b")])
    return whole.agg(F.count("*").alias("joined"), F.round(F.sum(F.col("a") + F.col("b")), 3).alias("total")).crossJoin(missing.agg(F.count("*").alias("missing")))


def s08(spark: SparkSession, d: str) -> DataFrame:
    """Every run of 700 events is a merged file that begins 137 rows into the next; each is found in the raw export."""
    raw = table(spark, d, "events").select(F.col("event_id").alias("row_no"), F.col("ts").cast("string").alias("t"), F.col("value").cast("string").alias("v"))
    at = F.col("row_no") - 137
    merged = raw.where("row_no >= 137").select(F.floor(at / 700).cast("long").alias("merged"), (at % 700).alias("row_no"), "t", "v")
    return H.row_offset(merged, raw, ["t", "v"])


def s09(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "graphml")
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.array(F.struct(F.lit("class").alias("_key"), F.col("p_type").alias("_VALUE")), F.struct(F.lit("x").alias("_key"), F.col("p_size").cast("string").alias("_VALUE"))).alias("data"))
    p.write.format("xml").option("maxRecordsPerFile", XML_ROWS).option("rootTag", "graph").option("rowTag", "node").save(path)
    nodes, _ = R.graph_keys(spark, path)
    return nodes.groupBy(F.col("data")["class"].alias("class")).agg(F.count("*").alias("n"), F.sum(F.col("data")["x"].cast("long")).alias("x"))


def s10(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "runs")
    p = table(spark, d, "part")
    box = F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)))
    sym = F.struct(F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 4 == 0, "robot").otherwise("pump").alias("class"), box.alias("box"))
    files = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("drawing")).agg(F.collect_list(sym).alias("symbols")).select(F.to_json(F.struct(F.col("drawing").cast("string").alias("drawing"), F.struct("symbols").alias("prediction"))).alias("value"))  # a drawing has 50 symbols
    files.write.text(path)
    raw = spark.read.schema(R.RUN).json(path).withColumn("file", F.col("drawing")).withColumns({"symbols": F.coalesce("prediction.symbols", "symbols")})
    good, bad = R.symbols(raw)
    g = good.groupBy("file").agg(F.count("*").alias("good"))
    return g.join(bad, "file", "full").select("file", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("malformed", F.lit(0)).alias("malformed"))


#: Loop lists that are written (fixed); all lines of a controller are in one.
LOOP_FILES = 250


def s12(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "loops")
    o = table(spark, d, "orders")
    line = F.concat_ws(",", F.concat(F.lit("FIC-"), F.col("o_orderkey") % 5000), F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("FT-"), "o_custkey")), F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("FIC "), F.col("o_orderkey") % 5000)).otherwise(F.lit("FV-1")), F.lit("x"))
    f = (F.col("o_orderkey") % 5000 % LOOP_FILES).alias("f")
    head = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("controller,measurement,output,description").alias("value")), F.struct(F.lit(1).alias("part"), F.lit("# note").alias("value"))))
    rows = o.select(f, F.lit(2).alias("part"), line.alias("value")).unionByName(o.select(f).distinct().select("f", head.alias("h")).select("f", "h.*"))
    rows.repartition("f").sortWithinPartitions("f", "part", "value").select("value", "f").write.partitionBy("f").text(path)
    good, refused = R.control_loops(spark, f"{path}/*/*.txt")
    return refused.groupBy("refusal").agg(F.count("*").alias("n")).unionByName(good.agg(F.count("*").alias("n")).select(F.lit("kept").alias("refusal"), "n")).where("n > 0")


def s13(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "lineage")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").repartition(3).write.option("header", True).csv(path)
    rows = R.list_with_lineage(spark, f"{path}/*.csv", "s_suppkey long, s_name string, s_acctbal double")
    return rows.select("s_suppkey", "s_name", "s_acctbal")


def s14(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("sheet"), F.col("l_partkey").cast("string").alias("tag"), F.lit("Flag").alias("field"), F.col("l_linestatus").alias("value"))
    good, clash = R.merged_schedule(li)
    return good.groupBy(F.col("value").alias("outcome")).agg(F.count("*").alias("n")).unionByName(clash.agg(F.count("*").alias("n")).select(F.lit("conflict").alias("outcome"), "n"))


def s15(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "register")
    c = table(spark, d, "customer")
    c.select(F.concat_ws(",", "c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 13 == 0, F.lit("many")).otherwise(F.col("c_nationkey").cast("string"))).alias("value")).write.text(path)
    raw = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema("k long, segment string, nation int, _bad string").csv(path)
    return written(raw, "register").groupBy(F.col("_bad").isNotNull().alias("bad")).agg(F.count("*").alias("n"))


def s16(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "drawing")
    a = lambda n, v, u: F.struct(F.lit(n).alias("_Name"), v.alias("_Value"), F.lit(u).alias("_Units"))
    p = table(spark, d, "part")
    attrs = F.array(F.struct(F.array(a("size", F.col("p_size").cast("string"), "mm"), a("size", F.col("p_brand"), ""), a("note", F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_name")), "")).alias("GenericAttribute")))
    p.select(F.col("p_partkey").cast("string").alias("_ID"), F.col("p_type").alias("_ComponentClass"), attrs.alias("GenericAttributes")).write.format("xml").option("maxRecordsPerFile", XML_ROWS).option("rootTag", "Plant").option("rowTag", "Equipment").save(path)
    claims, empty = R.generic_attributes(spark, path, "Equipment")
    return claims.groupBy("name").agg(F.count("*").alias("n")).unionByName(empty.agg(F.sum("empty").alias("n")).select(F.lit("empty").alias("name"), "n"))


def s17(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_linenumber <= 3")
    role = F.element_at(F.array(F.lit("controller"), F.lit("measurement"), F.lit("output")), F.col("l_linenumber"))
    members = li.select(F.lit("f").alias("file"), F.col("l_orderkey").alias("loop"), F.col("l_partkey").alias("id"), role.alias("role"), F.col("l_partkey").cast("string").alias("tag"))
    whole, part = R.loop_list(table(spark, d, "orders").select(F.lit("f").alias("file"), F.col("o_orderkey").alias("loop")), members)
    return whole.agg(F.count("*").alias("n")).select(F.lit("complete").alias("kind"), "n").unionByName(part.agg(F.count("*").alias("n")).select(F.lit("incomplete").alias("kind"), "n"))


def s19(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "flowsheet")
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    units = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "n_nationkey"), F.struct(F.when(F.col("n_nationkey") % 5 == 0, "Feed").otherwise("Mixer").alias("type")))))
    arcs = s.groupBy(F.floor(F.col("s_suppkey") / 50)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), "s_suppkey"), F.struct(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("n"), F.col("s_suppkey") % 25).alias("dest"))))).alias("arcs")).select("arcs")
    n.agg(units.alias("unit_models")).crossJoin(arcs).select(F.struct("unit_models", "arcs").alias("model")).repartition(8).write.option("maxRecordsPerFile", 1).json(path)  # a flowsheet of 50 streams a file
    return R.flowsheet(spark, path)[1].groupBy("source", "dest").agg(F.count("*").alias("streams"))


def s20(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = table(spark, d, "lineitem").withColumn("k", F.row_number().over(order))
    seg = li.groupBy(F.col("l_orderkey").alias("segment")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("items"))  # seven lines an order
    own = seg.select(F.lit("f").alias("file"), "segment", F.lit("IN").alias("from"), "items", F.lit("OUT").alias("to"))
    return R.chain_edges(own).groupBy("segment").agg(F.count("*").alias("edges"), F.count_if(F.col("b") == "OUT").alias("ends"))


def s21(spark: SparkSession, d: str) -> DataFrame:
    """Lines of eight parts as streams; every fifth size is a unit, every seventh of the others a battery limit."""
    p = table(spark, d, "part")
    e = p.where("p_partkey % 8 < 5").select(F.lit("f").alias("file"), F.floor(F.col("p_partkey") / 8).cast("long").alias("line"), F.col("p_partkey").alias("a"), F.explode(F.array(F.col("p_partkey") + 2, F.col("p_partkey") + 3)).alias("b"))
    kind = F.when(F.col("p_size") % 5 == 0, "unit").when(F.col("p_size") % 7 == 0, "battery limit")
    ends = p.select(F.lit("f").alias("file"), F.col("p_partkey").alias("id"), kind.alias("kind"), F.when(kind == "unit", F.col("p_name")).alias("of")).where("kind is not null")
    found = streams(e.where("floor(b / 8) = line"), ends)
    return found.select("line", "stream", "start", "end", F.size("path").alias("nodes"), "from_kind", "from_of", "to_kind", "to_of", "same_line_as")


def s22(spark: SparkSession, d: str) -> DataFrame:
    """The owning unit: the nearest upstream, else the nearest downstream; a thousand parts are a tree, a part feeds the one at twice its place."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 1000).alias("g"), (F.col("p_partkey") % 1000).alias("k"), (F.col("p_size") % 9 == 0).alias("unit"))
    e = p.where("k > 0").select("g", (F.col("k") * 2).alias("k"), F.col("id").alias("a")).join(p.select("g", "k", F.col("id").alias("b")), ["g", "k"]).select("a", "b")
    units = p.where("unit").select("id")
    up = G.owners(units, e).select("id", F.col("owner").alias("u"), F.col("hop").alias("up"))
    down = G.owners(units, e.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("id", F.col("owner").alias("w"), F.col("hop").alias("down"))
    own = p.join(up, "id", "left").join(down, "id", "left")
    why = F.when(F.col("unit"), "itself").when(F.col("u").isNotNull(), "upstream").when(F.col("w").isNotNull(), "downstream").otherwise("none")
    return own.select("id", F.coalesce("u", "w").alias("owner"), why.alias("why"), F.coalesce("up", "down").alias("hop"))


def s23(spark: SparkSession, d: str) -> DataFrame:
    """Instruments with tags by precedence, control letters and the outputs they drive."""
    p = table(spark, d, "part")
    category = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.element_at(F.array(F.lit("F"), F.lit("T"), F.lit("L")), (F.col("p_size") % 3 + 1).cast("int")), F.lit("IC-"), "p_partkey"))
    label = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("TT-"), "p_partkey"))
    tagged = p.select(F.col("p_partkey").alias("id"), F.coalesce(category, label, "p_brand").alias("tag"))
    drives = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count_distinct("l_suppkey").alias("outputs"))
    return tagged.join(drives, "id", "left").select("id", "tag", F.col("tag").rlike(r"^[A-Z]+C-").alias("controls"), F.coalesce("outputs", F.lit(0)).alias("outputs"))


# ---- streams


def t01(spark: SparkSession, d: str) -> DataFrame:
    path = T.sliced(readings(spark, d).select("run", "tag", F.col("ts").cast("timestamp").alias("ts"), "value"), 4)
    stream = T.with_quality(T.replay(spark, path, "run long, tag string, ts timestamp, value double", T.step_files(spark, path, 4)))
    return T.drained(stream, "append", "t01", spark).groupBy("run", "tag", "quality").agg(F.count("*").alias("n"))


def t02(spark: SparkSession, d: str) -> DataFrame:
    path = T.sliced(readings(spark, d).select("run", "tag", F.col("ts").cast("timestamp").alias("ts"), "value"), 4)
    stream = T.replay(spark, path, "run long, tag string, ts timestamp, value double", T.step_files(spark, path, 4))
    return T.drained(T.drift_alarms(stream, 15.0), "append", "t02", spark).select("run", "tag", "n", F.round("gap", 6).alias("gap"))


def t02_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Alarms by bands fitted on the readings, which follow the level; the bands meet the stream by series."""
    own = readings(spark, d)
    band = written(S.drift_bands(S.drift_stats(S.drift_gaps(own)), 3.0), "bands")
    path = T.sliced(own.select("run", "tag", F.col("ts").cast("timestamp").alias("ts"), "value"), 4)
    stream = T.replay(spark, path, "run long, tag string, ts timestamp, value double", T.step_files(spark, path, 4))
    events = T.drained(T.drift_events(stream, band, T.Rule(follow_level=True, bad_breaks=True)), "append", "t02f", spark)
    return events.select("run", "tag", "kind", "n", F.round("gap", 6).alias("gap"), "late")


def t03(spark: SparkSession, d: str) -> DataFrame:
    path = T.sliced(readings(spark, d).select("tag", F.col("ts").cast("timestamp").alias("ts"), "value"), 4)
    stream = T.replay(spark, path, "tag string, ts timestamp, value double", T.step_files(spark, path, 4))
    return T.drained(T.active_counts(stream, F.col("value") > 100), "complete", "t03", spark)


DRIFT3 = """, good AS (SELECT run, tag, row_no, value, row_number() OVER (PARTITION BY run, tag ORDER BY row_no) AS n FROM readings WHERE value IS NOT NULL),
walk AS (
  SELECT run, tag, n, value AS f, value AS s, 0.0::DOUBLE AS gap FROM good WHERE n = 1
  UNION ALL SELECT g.run, g.tag, g.n, w.f + greatest(1.0 / 10, 1.0 / g.n::DOUBLE) * (g.value - w.f), w.s + greatest(1.0 / 600, 1.0 / g.n::DOUBLE) * (g.value - w.s), w.f + greatest(1.0 / 10, 1.0 / g.n::DOUBLE) * (g.value - w.f) - w.s
  FROM walk w JOIN good g ON g.run = w.run AND g.tag = w.tag AND g.n = w.n + 1),
i AS (SELECT *, n - row_number() OVER (PARTITION BY run, tag ORDER BY n) AS island FROM walk WHERE abs(gap) > 15),
p AS (SELECT *, row_number() OVER (PARTITION BY run, tag, island ORDER BY n) AS k FROM i)
SELECT run, tag, n, round(gap, 6) AS gap FROM p WHERE k = 3"""

QUERIES = {
    "s01_wide_csv": (s01, WITH + """, p AS (SELECT *, CASE tag WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS pos FROM readings)
      SELECT tag, tag_pos, sum(good)::BIGINT AS good, round(sum(total), 4) AS total, sum(runs)::BIGINT AS runs
      FROM (SELECT tag, CASE WHEN run % 2 = 1 THEN 4 - pos ELSE pos END::INTEGER AS tag_pos, run % 2 AS odd, count(value) AS good, sum(value) AS total FROM p GROUP BY 1, 2, 3)
      JOIN (SELECT run % 2 AS odd, count(DISTINCT run) AS runs FROM readings GROUP BY 1) USING (odd) GROUP BY tag, tag_pos"""),
    "s01_findings": (s01_findings, """WITH e AS (SELECT event_id AS k, event_id // 500 AS f FROM events),
      r AS (SELECT *, CASE WHEN k % 41 = 7 THEN NULL WHEN f % 5 = 2 AND k % 2 = 0 THEN 'instant' WHEN f % 5 = 2 THEN 'local' ELSE 'number' END AS kind,
        CASE WHEN f % 5 = 2 THEN k ELSE k - CASE WHEN k % 67 = 3 THEN 9 ELSE 0 END END AS clk FROM e),
      s AS (SELECT *, lag(CASE WHEN kind IS NOT NULL THEN clk END) OVER (PARTITION BY f ORDER BY k) AS b FROM r),
      found AS (
        SELECT f, 'cells do not fit the header' AS finding FROM r WHERE k % 29 = 5
        UNION ALL SELECT f, 'no time' FROM r WHERE kind IS NULL
        UNION ALL SELECT f, 'time does not rise' FROM s WHERE kind IS NOT NULL AND clk <= b
        UNION ALL SELECT f, 'kinds or zones of time are mixed' FROM r GROUP BY f HAVING count(DISTINCT kind) > 1
        UNION ALL SELECT f, 'repeated tag name' FROM (SELECT DISTINCT f FROM e WHERE f % 7 = 3)
        UNION ALL SELECT f, unnest(['empty tag name', 'tag name is a number']) FROM (SELECT DISTINCT f FROM e WHERE f % 11 = 4 AND f % 7 <> 3))
      SELECT finding, count(*) AS n, count(DISTINCT f) AS files FROM found GROUP BY finding"""),
    "s01_order_findings": (s01_order, """SELECT 'time does not rise' AS finding, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS t, lag(date_trunc('hour', ts)) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS b FROM events) WHERE t <= b HAVING count(*) > 0"""),
    "s02_matrix": (s02, "SELECT c::INTEGER AS channel, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 0 AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 1, l_discount FROM lineitem UNION ALL SELECT 2, l_tax FROM lineitem) GROUP BY c"),
    "s03_labelled_runs": (s03, """SELECT "rows", first_anomaly, first_changepoint, count(*) AS runs FROM (SELECT event_id // 1000 AS f, count(*) AS "rows", min(event_id % 1000) FILTER (event_id % 1000 >= 700) AS first_anomaly, min(event_id % 1000) FILTER (event_id % 1000 = 650) AS first_changepoint FROM events GROUP BY 1) GROUP BY ALL"""),
    "s04_label_events": (s04, "SELECT first_row, last_row, samples, count(*) AS runs FROM (SELECT min(event_id % 1000) AS first_row, max(event_id % 1000) AS last_row, count(*) AS samples FROM events WHERE event_id % 50 >= 40 GROUP BY event_id // 50) GROUP BY ALL"),
    "s05_cycle_means": (s05, "SELECT count(*) AS cycles, round(sum(m), 3) AS total FROM (SELECT avg(l_quantity) AS m FROM lineitem GROUP BY l_orderkey)"),
    "s06_run_windows": (s06, """SELECT name, ts >= fault AS after_fault, count(*) AS n FROM events JOIN (VALUES ('a', TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-07', TIMESTAMP '2024-01-06'), ('b', TIMESTAMP '2024-01-06 12:00:00', TIMESTAMP '2024-01-09', TIMESTAMP '2024-01-08')) AS w(name, a, b, fault) ON ts >= a AND ts <= b GROUP BY ALL"""),
    "s07_decimal_comma": (s07, "SELECT count(*) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0) AS joined, round(2 * sum(value) FILTER (event_id % 7 <> 0 AND event_id % 5 <> 0), 3) AS total, count(*) FILTER ((event_id % 7 = 0) <> (event_id % 5 = 0)) AS missing FROM events"),
    "s08_row_offset": (s08, 'SELECT DISTINCT (event_id - 137) // 700 AS merged, 137 + (event_id - 137) // 700 * 700 AS "offset" FROM events WHERE event_id >= 137'),
    "s09_graph_keys": (s09, "SELECT p_type AS class, count(*) AS n, sum(p_size)::BIGINT AS x FROM part GROUP BY p_type"),
    "s10_run_records": (s10, """SELECT (p_partkey // 50)::VARCHAR AS file, count(*) FILTER (p_partkey % 6 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 4 <> 0) AS good, count(*) FILTER (p_partkey % 6 = 0 OR p_partkey % 10 = 0 OR p_partkey % 4 = 0) AS malformed FROM part GROUP BY 1"""),
    "s12_control_loops": (s12, """WITH o AS (SELECT o_orderkey AS k, count(*) OVER (PARTITION BY o_orderkey % 5000) AS same FROM orders)
      SELECT CASE WHEN k % 7 = 0 THEN 'empty field' WHEN same > 1 THEN 'repeated controller' WHEN k % 11 = 0 THEN 'output is its controller' ELSE 'kept' END AS refusal, count(*) AS n FROM o GROUP BY 1"""),
    "s13_list_lineage": (s13, "SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "s14_schedule_merge": (s14, "SELECT CASE WHEN n > 1 THEN 'conflict' ELSE v END AS outcome, count(*) AS n FROM (SELECT l_partkey, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS v FROM lineitem GROUP BY 1) GROUP BY 1"),
    "s15_checked_csv": (s15, "SELECT c_custkey % 13 = 0 AS bad, count(*) AS n FROM customer GROUP BY 1"),
    "s16_generic_attributes": (s16, "SELECT 'size' AS name, count(*) AS n FROM part UNION ALL SELECT 'size#2', count(*) FROM part UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN 'empty' ELSE 'note' END, count(*) FROM part GROUP BY 1"),
    "s17_loop_list": (s17, """SELECT CASE WHEN n = 3 THEN 'complete' ELSE 'incomplete' END AS kind, count(*) AS n FROM (SELECT o_orderkey, count(DISTINCT l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <= 3 GROUP BY 1) GROUP BY 1"""),
    "s19_flowsheet": (s19, """SELECT CASE WHEN s_nationkey % 5 = 0 THEN 'battery limit' ELSE 'n' || s_nationkey END AS source, CASE WHEN s_suppkey % 25 % 5 = 0 THEN 'battery limit' ELSE 'n' || (s_suppkey % 25) END AS dest, count(*) AS streams FROM supplier GROUP BY ALL"""),
    "s20_chain_edges": (s20, "SELECT l_orderkey AS segment, count(*) + 1 AS edges, 1::BIGINT AS ends FROM lineitem GROUP BY 1"),
    "s21_streams": (s21, """WITH RECURSIVE e AS (SELECT p_partkey // 8 AS line, p_partkey AS a, p_partkey + d AS b FROM part, (VALUES (2), (3)) AS t(d) WHERE p_partkey % 8 < 5 AND (p_partkey + d) // 8 = p_partkey // 8),
      w AS (SELECT DISTINCT line, a AS start, a AS cur, [a] AS path FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT w.line, start, b, list_append(path, b) FROM w JOIN e ON e.a = w.cur),
      f AS (SELECT line, start, cur AS "end", min(path) AS path FROM w WHERE cur NOT IN (SELECT a FROM e) GROUP BY ALL),
      t AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'unit' ELSE 'battery limit' END AS kind, CASE WHEN p_size % 5 = 0 THEN p_name END AS of FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0),
      up AS (SELECT id, id AS owner, 0 AS hop FROM t UNION ALL SELECT e.b, owner, hop + 1 FROM up JOIN e ON e.a = up.id),
      dn AS (SELECT id, id AS owner, 0 AS hop FROM t UNION ALL SELECT e.a, owner, hop + 1 FROM dn JOIN e ON e.b = dn.id),
      u AS (SELECT id, arg_min(owner, hop::BIGINT * 1000000000 + owner) AS owner FROM up GROUP BY id), v AS (SELECT id, arg_min(owner, hop::BIGINT * 1000000000 + owner) AS owner FROM dn GROUP BY id),
      k AS (SELECT f.*, coalesce(x.kind, 'closed') AS from_kind, x.of AS from_of, coalesce(y.kind, 'closed') AS to_kind, y.of AS to_of FROM f LEFT JOIN u ON u.id = f.start LEFT JOIN t x ON x.id = u.owner LEFT JOIN v ON v.id = f."end" LEFT JOIN t y ON y.id = v.owner),
      n AS (SELECT *, (from_kind = 'closed' OR to_kind = 'closed')::INT AS shut FROM k),
      r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY shut, start, "end")::INTEGER AS stream, min(shut) OVER (PARTITION BY line) AS open FROM n)
      SELECT line, stream, start, "end", len(path)::INTEGER AS nodes, from_kind, from_of, to_kind, to_of, CASE WHEN stream > 1 THEN 1 END AS same_line_as FROM r WHERE shut = 0 OR (open = 1 AND stream = 1)"""),
    "s22_owning_unit": (s22, """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_partkey // 1000 AS g, p_partkey % 1000 AS k, p_size % 9 = 0 AS unit FROM part),
      e AS (SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON x.g = y.g AND y.k = 2 * x.k AND x.k > 0),
      u AS (SELECT id AS start, id, 0 AS hop FROM p WHERE unit UNION ALL SELECT u.start, e.b, hop + 1 FROM u JOIN e ON e.a = u.id),
      v AS (SELECT id AS start, id, 0 AS hop FROM p WHERE unit UNION ALL SELECT v.start, e.a, hop + 1 FROM v JOIN e ON e.b = v.id),
      m AS (SELECT id, arg_min(start, hop::BIGINT * 1000000000 + start) AS start, min(hop) AS hop FROM u GROUP BY id), n AS (SELECT id, arg_min(start, hop::BIGINT * 1000000000 + start) AS start, min(hop) AS hop FROM v GROUP BY id)
      SELECT p.id, coalesce(m.start, n.start) AS owner, CASE WHEN unit THEN 'itself' WHEN m.start IS NOT NULL THEN 'upstream' WHEN n.start IS NOT NULL THEN 'downstream' ELSE 'none' END AS why, coalesce(m.hop, n.hop)::INTEGER AS hop
      FROM p LEFT JOIN m USING (id) LEFT JOIN n USING (id)"""),
    "s23_instruments": (s23, """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN (['F', 'T', 'L'])[p_size % 3 + 1] || 'IC-' || p_partkey WHEN 1 THEN 'TT-' || p_partkey ELSE p_brand END AS tag, p_partkey % 3 = 0 AS controls, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS outputs FROM part"""),
    "t01_replay": (t01, WITH + "SELECT run, tag, CASE WHEN value IS NULL THEN 'bad' ELSE 'good' END AS quality, count(*) AS n FROM readings GROUP BY ALL"),
    "t02_drift_alarms": (t02, "WITH RECURSIVE " + READINGS + DRIFT3),
    "t02_fitted_alarms": (t02_fitted, DRIFT + """, f AS (SELECT w.*, CASE WHEN b.mean = 0 THEN 1.0 ELSE least(1.0, greatest(0.5, abs(level) / abs(b.mean))) END AS r, b.gap_mean, b.half_width FROM walk w JOIN dbands b USING (run, tag)),
      i AS (SELECT *, row_no - row_number() OVER (PARTITION BY run, tag ORDER BY row_no) AS island FROM f WHERE abs(gap - gap_mean * r) > half_width * r),
      p AS (SELECT *, row_number() OVER (PARTITION BY run, tag, island ORDER BY row_no) AS k FROM i)
      SELECT run, tag, 'alarm' AS kind, n, round(gap, 6) AS gap, 0::BIGINT AS late FROM p WHERE k = 3"""),
    "t03_active_counts": (t03, WITH + "SELECT tag, count(*) AS samples, count(*) FILTER (value IS NULL) AS bad, count(*) FILTER (value > 100) AS out_of_band FROM readings GROUP BY tag"),
}
