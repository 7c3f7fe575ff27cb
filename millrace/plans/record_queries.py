"""Queries for mapping, audits, rules, graphs, ledgers and reports, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace import sinks
from millrace.functions import text as T
from millrace.operators import audits as A
from millrace.operators import checks as C
from millrace.operators import graphs as G
from millrace.operators import impact
from millrace.operators import pipes as P
from millrace.operators import records as R
from millrace.operators import renames as N
from millrace.operators import rules as Q
from millrace.operators.identity import sheet_identity
from millrace.plans.standins import ITEMS, LINKS, items, links, table
from millrace.scratch import new_path

I_ = "WITH " + ITEMS
RL = "WITH RECURSIVE " + LINKS


# ---- projections


def p01(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit(" "), F.substring("s_name", 1, 3), F.lit("_-/ ."), F.substring("s_name", 10, 9)).alias("t"))
    return t.select("id", T.tag_strict(F.col("t")).alias("strict"), T.tag_lenient(F.col("t")).alias("lenient"), T.tag_map(F.col("t")).alias("mapped"), T.tag_compact(F.col("t")).alias("compact"), T.tag_screen(F.col("t")).alias("screen"))


def p01_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility forms of whole documents, by length and checksum."""
    t = table(spark, d, "documents").select("doc_id", T.nfkc(F.coalesce("text", F.lit(""))).alias("form"))
    return t.select("doc_id", F.length("form").alias("chars"), F.crc32(F.col("form").cast("binary")).alias("crc"))


def p02(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    letters = T.isa_letters(F.col("tag"))
    return i.select("id", letters.alias("letters"), T.isa_loop(F.col("tag")).alias("loop"), T.isa_variable(letters).alias("variable"), T.plant_coded(letters, F.array(F.lit("LA"), F.lit("XV"))).alias("plant_coded"))


def p03(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("to "), "p_name", F.lit(" dwg PD-"), F.lpad(F.col("p_partkey").cast("string"), 4, "0")).alias("t"))
    off = T.offpage(F.col("t"))
    return t.select("id", off["ref"].alias("ref"), off["code"].alias("code"), F.array_join(F.array_sort(off["words"]), " ").alias("words"))


def p04(spark: SparkSession, d: str) -> DataFrame:
    spec = {"kind": ["economy", "standard"], "text": "^(fic|ti)", "not_text": "0$", "price_min": 920, "size_max": 40}
    return items(spark, d).where(R.selector(spec)).select("id", "tag", "kind")


def p05(spark: SparkSession, d: str) -> DataFrame:
    """Items of rejected suppliers' parts are left out."""
    rejected = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_partkey").alias("id")).distinct()
    return items(spark, d).join(rejected, "id", "left_anti").where(~F.col("tag").rlike("^(?i)lahh")).select("id", "tag")


def p06(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.from_json("props", "k int").alias("props"), F.array(F.col("event_type"), F.lit("x")).alias("tags"), F.col("user_id").alias("user"))).alias("j"))
    return R.flattened(own, "event_id", "j")


def p07(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    verified = F.when(F.col("o_orderstatus") == "F", "verified")
    topology = F.when(F.col("o_orderkey") % 7 == 0, "topology")
    return o.select("o_orderkey", R.status_of(verified, topology).alias("status"), F.when(F.col("o_orderpriority").rlike("URGENT|HIGH"), "expert").otherwise("machine").alias("track"))


def p08(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "lineitem").select(F.concat("l_returnflag", F.lit("["), "l_linenumber", F.lit("]."), "l_linestatus").alias("name"))
    return R.profile(claims, r"^[AN]\.")[1]


def p09(spark: SparkSession, d: str) -> DataFrame:
    role = C.first_rule([("instrument", F.col("tag").rlike("^(FIC|TI)")), ("line_item", F.col("tag").rlike("^(PSV|XV)")), ("offpage", F.col("kind") == "promo")], "equipment")
    return items(spark, d).select("id", role.alias("role"))


def p10(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).withColumn("function", R.safety_class(F.col("tag"))).withColumn("tier", F.when(F.col("size") < 20, "green").otherwise("amber"))
    floor = F.when(F.col("function").isNotNull() & (F.col("tier") == "green"), "amber").otherwise(F.col("tier"))
    return i.withColumn("floor", floor).groupBy("function", "tier", "floor").agg(F.count("*").alias("n"))


def p11(spark: SparkSession, d: str) -> DataFrame:
    """Isolation points: degree of parts in the link graph with their tag class."""
    degree = G.both_ways(links(spark, d)).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    kind = F.when(F.col("tag").rlike("^XV"), "operated").when(F.coalesce("degree", F.lit(0)) >= 3, "branch").when(F.col("degree") == 2, "inline")
    return items(spark, d).join(degree, "id", "left").withColumn("point", kind).where("point is not null").select("id", "point", F.coalesce("degree", F.lit(0)).alias("degree"))


def p12(spark: SparkSession, d: str) -> DataFrame:
    """Purpose by precedence: schedule, then name, then tag, with its source."""
    schedule, drawn = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")), F.when(F.col("p_name").contains("ring"), F.col("p_name"))
    best = C.first_source([("schedule", schedule), ("drawing", drawn), ("tag", F.col("p_brand"))])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), best["text"].alias("purpose"), best["source"].alias("source"))


def p13(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("N/A")).when(F.col("o_orderkey") % 7 == 0, F.lit("  ")).when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority"))
    return table(spark, d, "orders").withColumn("state", T.field_state(raw)).groupBy("state").agg(F.count("*").alias("n"))


def p15(spark: SparkSession, d: str) -> DataFrame:
    """Rules on readings with an error bound of one unit either way."""
    rules = spark.createDataFrame([("low", 10.0, "below"), ("high", 120.0, "above")], "rule string, limit double, side string")
    own = table(spark, d, "events").crossJoin(F.broadcast(rules))  # a rule table of two rows
    return own.groupBy("rule", "event_type", C.three_state(F.col("value"), F.lit(1.0), F.col("limit"), F.col("side")).alias("state")).agg(F.count("*").alias("n"))


def p16(spark: SparkSession, d: str) -> DataFrame:
    """A range-coded analyser becomes a row per component."""
    return C.channels(items(spark, d).where("tag like 'TI-%'").withColumn("parts", F.col("size") % 3 + 1), "parts")


def p17(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).select("id", "tag")
    mapping = i.where("id < 40").select(F.col("tag").alias("old"), F.concat(F.lit("N-"), "tag").alias("new"))
    return R.renamed(i, mapping)[0].select("id", "tag", "former_tag")


def p18(spark: SparkSession, d: str) -> DataFrame:
    """Units by precedence: the item's, its kind's, none; findings where they disagree."""
    own = F.when(F.col("size") % 4 == 0, F.lit("bar")).when(F.col("size") % 4 == 1, F.lit("kPa"))
    kind = F.when(F.col("kind") == "economy", F.lit("bar")).when(F.col("kind") == "standard", F.lit("kPa"))
    i = items(spark, d).withColumns({"own": own, "by_kind": kind})
    return i.select("id", C.first_source([("item", F.col("own")), ("kind", F.col("by_kind"))])["text"].alias("uom"), C.unit_findings(F.col("own"), F.col("by_kind")).alias("finding"))


# ---- mapping and audits


def j02(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "customer").select(F.col("c_custkey").alias("row"), F.concat(F.element_at(F.array(*map(F.lit, ("FIC", "TI", "PSV", "LAHH", "XV"))), (F.col("c_custkey") % 5 + 1).cast("int")), F.lit("-"), (F.col("c_custkey") * 3 % 900).cast("string")).alias("tag"))
    return R.map_points(listed, items(spark, d), "tag")


def j03(spark: SparkSession, d: str) -> DataFrame:
    """Points by exact id; rejected parts are blocked."""
    points = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_returnflag")
    i = items(spark, d).select("id", (F.col("size") == 13).alias("rejected"))
    j = points.join(i, "id", "left")
    outcome = F.when(F.col("rejected").isNull(), "unknown id").when(F.col("rejected"), "blocked").otherwise("mapped")
    return j.groupBy(outcome.alias("outcome"), "l_returnflag").agg(F.count("*").alias("n"))


def j04(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    before = c.where("c_custkey % 10 <> 3").select("c_custkey", F.col("c_mktsegment").alias("v"))
    after = c.where("c_custkey % 10 <> 4").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("v"))
    return R.changes(before, after, "c_custkey", "v")


def j05(spark: SparkSession, d: str) -> DataFrame:
    """Loop audit: an order is a loop; its controller, measurement and output are its first three lines' parts."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 3")
    present = items(spark, d).where("size > 10").select(F.col("id").alias("l_partkey"), F.lit(True).alias("here"))
    loop = li.join(present, "l_partkey", "left").groupBy("l_orderkey").agg(*[F.coalesce(F.max(F.when(F.col("l_linenumber") == n, F.coalesce("here", F.lit(False)))), F.lit(False)).alias(c) for n, c in ((1, "controller"), (2, "measurement"), (3, "output"))])
    n = sum((F.col(c).cast("int") for c in ("measurement", "output")), F.col("controller").cast("int"))
    return loop.groupBy("controller", "measurement", "output", F.when(n == 3, "drawn").when(n > 0, "partly").otherwise("not drawn").alias("status")).agg(F.count("*").alias("loops"))


def j06(spark: SparkSession, d: str) -> DataFrame:
    """Tag presence only, on the compact spelling."""
    loops = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("fic "), (F.col("o_orderkey") % 900).cast("string")).alias("controller"), F.concat(F.lit("TI_"), (F.col("o_custkey") % 900).cast("string")).alias("measurement"))
    return C.tags_present(loops, items(spark, d), ["controller", "measurement"]).groupBy("status").agg(F.count("*").alias("loops"))


def j07(spark: SparkSession, d: str) -> DataFrame:
    """Numbering: all tags of a loop share one number."""
    numbers = items(spark, d).select(F.col("id").alias("l_partkey"), T.isa_loop(F.col("tag")).alias("number"))
    members = table(spark, d, "lineitem").join(numbers, "l_partkey").select(F.col("l_orderkey").alias("loop"), "number")
    return C.numbering(members).groupBy("one_number", "tags").agg(F.count("*").alias("loops"))


def j08(spark: SparkSession, d: str) -> DataFrame:
    """Off-page connectors: every part names the sheet one or two away, or one that is not there; every ninth sheet has no number."""
    sheet = F.floor(F.col("p_partkey") / 40).cast("long")
    ref = F.when(F.col("p_partkey") % 4 == 0, sheet.bitwiseXOR(F.lit(1))).when(F.col("p_partkey") % 4 == 1, sheet.bitwiseXOR(F.lit(2))).when(F.col("p_partkey") % 4 == 2, sheet + 1_000_000)
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), sheet.alias("sheet"), ref.cast("string").alias("ref"), F.concat(F.lit("S"), sheet.bitwiseXOR(F.lit(1))).alias("code"), F.split("p_name", " ").alias("words"))
    sheets = own.select("sheet").distinct().select("sheet", F.when(F.col("sheet") % 9 != 4, F.col("sheet").cast("string")).alias("number"), F.concat(F.lit("S"), "sheet").alias("system_code"))
    return A.pair_connectors(own, sheets)


def j05_signals(spark: SparkSession, d: str) -> DataFrame:
    """Loops of five parts, most with their symbols, signal lines within a sheet, and flags where an order crosses sheets."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    loops = p.where("p_partkey % 5 = 0").select(k.alias("loop"), F.concat(F.lit("FIC-"), k).alias("controller"), F.concat(F.lit("FT-"), F.when(k % 15 == 0, k).otherwise(k + 1)).alias("measurement"), F.concat(F.lit("FV "), k + 2).alias("output"))
    loops = loops.withColumn("measurement", F.when(F.col("loop") % 35 == 0, F.col("controller")).otherwise(F.col("measurement")))
    text = F.when(k % 5 == 0, F.concat(F.lit("fic_"), k)).when(k % 5 == 1, F.concat(F.lit("FT"), k)).when(k % 5 == 2, F.concat(F.lit("FV-"), k))
    symbols = p.where("p_size % 10 <> 3").select(F.floor(k / 40).cast("long").alias("drawing"), k.alias("id"), text.alias("text"), F.when(k % 5 == 3, F.concat(F.lit("fv-"), k - 1)).alias("signal_to"), F.when(k % 5 == 4, F.concat(F.lit("FIC "), k - 4)).alias("signal_from"))
    line = lambda a, b, c: p.where(c).select(F.floor(k / 40).cast("long").alias("drawing"), (k + a).alias("a"), (k + b).alias("b"))
    signals = line(1, 0, "p_partkey % 5 = 0 and p_size % 4 <> 1").unionByName(line(0, 2, "p_partkey % 5 = 0 and p_size % 3 = 0")).unionByName(line(0, 3, "p_partkey % 5 = 0 and p_size % 2 = 0")).unionByName(line(4, 2, "p_partkey % 5 = 0"))
    return A.loop_audit(loops, symbols, signals)


def j09(spark: SparkSession, d: str) -> DataFrame:
    """System and drawing number of sheets of forty parts: brands are systems, sheets point to numbers by their parts' sizes, every ninth sheet is registered."""
    sheet = F.floor(F.col("p_partkey") / 40).cast("long")
    p = table(spark, d, "part").select(sheet.alias("sheet"), "p_partkey", "p_size", F.col("p_brand").alias("code"))
    number = F.concat(F.lit("D"), (F.col("p_partkey") * 7 + F.col("p_size")) % 1000)
    refs = p.where("p_size % 10 = 0").select("sheet", "code", number.alias("number"))
    register = p.select("sheet").distinct().where("sheet % 9 = 0").select("sheet", F.lit("REG").alias("system_code"), F.concat(F.lit("R"), "sheet").alias("drawing_number"))
    return sheet_identity(p.select("sheet", "code"), refs, register)


def j09_codes(spark: SparkSession, d: str) -> DataFrame:
    """A sheet's system is the most frequent brand of its parts; ties are unknown."""
    return C.sheet_identity(table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("long").alias("sheet"), F.col("p_brand").alias("system")))


def j13(spark: SparkSession, d: str) -> DataFrame:
    """Relations of anchors (PSV) to candidates (XV): same unit, other unit of the same sheet."""
    i = items(spark, d)
    a, c = i.where("tag like 'PSV%'").alias("a"), i.where("tag like 'XV%'").alias("c")
    unit = a.join(c, F.col("a.unit") == F.col("c.unit")).select(F.col("a.id").alias("anchor"), F.lit("same_unit").alias("relation"))
    sheet = a.join(c, (F.col("a.sheet") == F.col("c.sheet")) & (F.col("a.unit") != F.col("c.unit"))).select(F.col("a.id").alias("anchor"), F.lit("other_unit").alias("relation"))
    return unit.unionByName(sheet).groupBy("anchor", "relation").agg(F.count("*").alias("n"))


CATALOG = [
    {"id": "q1", "anchor": {"text": "^psv"}, "with": [{"match": {"text": "^fic"}, "on": ["sheet"]}], "without": [{"match": {"text": "^lahh", "size_min": 30}, "on": ["sheet"]}], "group": "sheet"},
    {"id": "q2", "anchor": {"text": "^ti", "price_min": 905}, "with": [{"match": {"text": "^ti", "size_max": 5}, "on": ["unit"]}], "group": "unit", "min_anchors": 2},
]


def j14(spark: SparkSession, d: str) -> DataFrame:
    return R.screen(items(spark, d), CATALOG)


KINDS = ("controller", "instrument", "valve", "interlock", "equipment")


def plant(spark: SparkSession, d: str) -> Q.Model:
    """Parts as a plant: five parts are a unit with its controller, instrument, valve, interlock and equipment; ten are on a stream."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    tag = F.concat(F.element_at(F.array(*map(F.lit, ("FIC", "TI", "PSV", "LAHH", "K"))), (k % 5 + 1).cast("int")), F.lit("-"), k)
    equipment = p.where("p_partkey % 5 = 4").select(k.alias("e"))
    unit = F.when((k % 5 != 4) & (k % 17 != 0), k - k % 5 + 4)
    read = F.when((k % 5 == 0) & (k % 4 != 0), F.concat(F.lit("TI "), k + 1)).when((k % 5 == 3) & (k % 3 == 0), F.concat(F.lit("ti_"), k - 2))
    writes = F.when((k % 5 == 0) & (k % 3 != 0), F.array(F.concat(F.lit("psv"), k + 2)))
    own = p.select(k.alias("id"), F.element_at(F.array(*map(F.lit, KINDS)), (k % 5 + 1).cast("int")).alias("kind"), tag.alias("tag"), unit.alias("u"), F.floor(k / 10).cast("long").alias("stream"), F.floor(k / 40).cast("long").alias("sheet"), F.col("p_name").alias("text"), read.alias("measurement"), writes.alias("outputs"))
    placed = own.join(equipment, F.col("u") == F.col("e"), "left").withColumnRenamed("e", "unit").drop("u")
    streams = equipment.where("e % 10 = 4").join(equipment.select((F.col("e") - 5).alias("e"), F.col("e").alias("dst")), "e").select(F.floor(F.col("e") / 10).cast("long").alias("stream"), F.col("e").alias("src"), "dst")
    return Q.Model(placed, streams, links(spark, d), {"hot": "hot", "colour": "red|blue", "size": "small|large"})


def j13_relations(spark: SparkSession, d: str) -> DataFrame:
    """How many instruments and valves have a partner by each relation, and how many pairs they make."""
    m = plant(spark, d)
    anchors = m.items.where("kind in ('instrument', 'valve')")
    named = [Q.pairs(m, anchors, m.items, r).agg(F.count_distinct("anchor").alias("anchors"), F.count("*").alias("pairs")).select(F.lit(r).alias("relation"), "anchors", "pairs") for r in ("same_stream", "same_unit", "same_unit_same_medium", "drives", "reads", "linked", "discharge_side")]
    some = [Q.having(m, anchors, {"relation": r, "select": {"kind": ["valve"], "text": "^hot ring"}}).agg(F.count("*").alias("anchors")).select(F.lit(r).alias("relation"), "anchors", F.lit(None).cast("long").alias("pairs")) for r in ("anywhere", "other_unit")]
    return reduce(DataFrame.unionByName, named + some)


RULES = [
    {
        "id": "r1", "anchor": {"kind": ["valve"], "text": "hot"}, "group_by": "unit", "unit_not_text": "bolt|rod",
        "with": [{"relation": "drives", "select": {"kind": ["controller"]}}], "without": [{"relation": "same_unit", "select": {"kind": ["interlock"], "text": "small"}}],
        "also_show": [{"relation": "same_stream", "select": {"kind": ["instrument"]}}],
    },
    {
        "id": "r2", "anchor": {"kind": ["instrument"]}, "group_by": "model", "needs_model": ["interlock"], "min_anchors": 2,
        "with": [{"relation": "reads", "select": {}}, {"relation": "other_unit", "select": {"kind": ["interlock"], "text": "^hot ring"}}],
    },
    {"id": "r3", "anchor": {"kind": ["equipment"]}, "needs_model": ["boiler"]},
]


def j14_rules(spark: SparkSession, d: str) -> DataFrame:
    return Q.run_all(plant(spark, d), RULES)


def j02_plan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of a point list: by pinned id or tag, some without address, some for one target twice; items of every seventh part are rejected."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("row"), F.concat(F.lit("fic "), k * 5 % 4000).alias("tag"), F.when(k % 3 == 0, (k % 1200).cast("string")).otherwise(" ").alias("asset_id"), F.when(k % 11 != 0, "srv").alias("server"), F.lit("base").alias("base_path"), F.concat(F.lit("p"), k).alias("point"))
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("FIC-"), F.col("p_partkey") - F.col("p_partkey") % 10).alias("tag"), F.floor(F.col("p_partkey") / 40).cast("long").alias("sheet"), (F.col("p_partkey") % 7 == 0).alias("rejected"), (F.col("p_partkey") % 10 != 5).alias("placeholder"))
    plan = R.plan_mapping(rows, own)
    return plan.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("asset").alias("assets"))


def j25_repair(spark: SparkSession, d: str) -> DataFrame:
    """Streams with one end or both swapped or wrong against the allowed segments of their number."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    allowed = s.select((k % 400).alias("number"), (k % 40).alias("a"), (k % 40 + 1).alias("b")).unionByName(s.where("s_suppkey % 5 = 0").select((k % 400).alias("number"), (k % 40).alias("a"), (k % 40 + 2).alias("b"))).distinct()
    a, b = k % 40, k % 40 + 1
    drawn = s.select(k.alias("id"), (k % 400 + F.when(k % 29 == 3, 1000).otherwise(0)).alias("number"), F.when(k % 7 == 1, b).when(k % 7 == 2, a + 50).when(k % 7 == 4, a + 60).otherwise(a).alias("a"), F.when(k % 7 == 1, a).when(k % 7 == 3, b + 50).when(k % 7 == 4, b + 60).otherwise(b).alias("b"))
    return R.checked_streams(drawn, allowed).groupBy("result", "fix").agg(F.count("*").alias("n"))


def j15(spark: SparkSession, d: str) -> DataFrame:
    own = items(spark, d).select(F.col("sheet").alias("place"), F.when(F.col("size") % 5 != 0, F.col("kind")).alias("service"), F.when(F.col("size") % 3 == 0, F.lit("-")).otherwise(F.col("tag")).alias("rating"), F.col("tag").alias("label"))
    return R.requests(own, ["service", "rating", "label"])


def j16(spark: SparkSession, d: str) -> DataFrame:
    o, li, p, c = (table(spark, d, n) for n in ("orders", "lineitem", "part", "customer"))
    checks = {
        "duplicate line": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")),
        "dangling order": li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti").select(F.col("l_orderkey").alias("id")).distinct(),
        "dangling part": li.join(p, li["l_partkey"] == p["p_partkey"], "left_anti").select(F.col("l_partkey").alias("id")).distinct(),
        "dangling customer": o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").select(F.col("o_custkey").alias("id")).distinct(),
        "unknown status": o.where(~F.col("o_orderstatus").isin("O", "F")).select(F.col("o_orderkey").alias("id")),
    }
    return R.violations(checks)


def j17(spark: SparkSession, d: str) -> DataFrame:
    """Model against model: by tag; role and fields compared; missing and extra."""
    i = items(spark, d).select(F.concat_ws("#", "tag", "id").alias("tag"), "kind", "unit")
    other = i.where("unit % 9 <> 4").select("tag", F.when(F.col("unit") % 10 == 1, F.lit("other")).otherwise(F.col("kind")).alias("kind"), F.when(F.col("unit") % 11 == 1, F.col("unit") + 1).otherwise(F.col("unit")).alias("unit"))
    extra = spark.range(3).select(F.concat(F.lit("NEW-"), F.col("id").cast("string")).alias("tag"), F.lit("economy").alias("kind"), F.lit(1).cast("long").alias("unit"))
    return C.model_diff(i, other.unionByName(extra), "tag", "kind", ["unit"]).groupBy("status").agg(F.count("*").alias("n"))


def j18(spark: SparkSession, d: str) -> DataFrame:
    """Multisets of line types per order, drawn and modelled."""
    li = table(spark, d, "lineitem")
    return C.multiset_diff(li, li.where("l_quantity > 3"), "l_orderkey", "l_returnflag").select("l_orderkey").distinct()


def j19(spark: SparkSession, d: str) -> DataFrame:
    """Claims against model fields: equal, different, no field."""
    p = table(spark, d, "part")
    claims = p.select(F.col("p_partkey").alias("owner"), F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.when(F.col("p_partkey") % 9 == 0, F.lit("Brand#0")).otherwise(F.col("p_brand")), F.lit("colour"), F.lit("red"))).alias("name", "claimed"))
    fields = p.select(F.col("p_partkey").alias("owner"), F.explode(F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).alias("name", "held"))
    return C.claim_check(claims, fields).groupBy("name", "result").agg(F.count("*").alias("n"))


def j24(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts checked against their neighbours' words: confirmed by a shared word, corrected, unverified."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.tokens(F.col("p_name")).alias("words"))
    return C.name_check(p, p.select((F.col("id") + 1).alias("id"), "words")).groupBy("result").agg(F.count("*").alias("n"))


def j25(spark: SparkSession, d: str) -> DataFrame:
    """Stream ends against allowed segments: confirmed, reversed, unresolved."""
    allowed = table(spark, d, "nation").select(F.col("n_nationkey").alias("f"), F.col("n_regionkey").alias("t"), F.lit(True).alias("ok"))
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 5).otherwise(F.col("s_nationkey")).cast("int").alias("a"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).otherwise(F.col("s_nationkey") % 5).cast("int").alias("b"))
    one = s.join(allowed, (F.col("a") == F.col("f")) & (F.col("b") == F.col("t")), "left").withColumnRenamed("ok", "fits").drop("f", "t")
    two = one.join(allowed, (F.col("b") == F.col("f")) & (F.col("a") == F.col("t")), "left")
    return two.groupBy(F.when(F.col("fits"), "confirmed").when(F.col("ok"), "corrected").otherwise("unresolvable").alias("result")).agg(F.count("*").alias("n"))


def j27(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts of a sheet that share exactly one order."""
    return C.shared_networks(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("network"), F.floor(F.col("l_partkey") / 40).alias("sheet"), F.col("l_partkey").alias("id")))


def j30(spark: SparkSession, d: str) -> DataFrame:
    """Live tags: the first and last reading of each user and type, and whether it moved."""
    return C.movement(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])


def j31(spark: SparkSession, d: str) -> DataFrame:
    """Quality honesty: fed tags must be good and in range; reported, not clipped."""
    e = table(spark, d, "events").withColumn("quality", F.when(F.col("event_id") % 97 == 0, "bad").otherwise("good"))
    return C.out_of_range(e, ["event_type", "quality"], 0, 200)


def j32(spark: SparkSession, d: str) -> DataFrame:
    """Stated numbers against results, rounded to the stated places."""
    made = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("value"))
    claims = made.select("o_orderpriority", F.when(F.col("o_orderpriority") == "5-LOW", F.round("value", 1) + 1).otherwise(F.round("value", 1)).alias("stated"))
    return C.stated_numbers(claims, made, "o_orderpriority", 1)


def j33(spark: SparkSession, d: str) -> DataFrame:
    """Stages are parts; each feeds the one at twice its number."""
    p = table(spark, d, "part").where("p_partkey > 0")
    rec = p.where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("stage"), F.md5(F.col("p_name").cast("binary")).alias("hash"))
    cur = p.where("p_partkey % 19 <> 0").select(F.col("p_partkey").alias("stage"), F.md5(F.when(F.col("p_partkey") % 23 == 0, F.lit("new")).otherwise(F.col("p_name")).cast("binary")).alias("hash"))
    up = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") * 2).alias("b")).join(p.select(F.col("p_partkey").alias("b")), "b", "left_semi")
    return R.freshness(rec, cur, up)


def j34(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).where("size > 5").select("tag")
    return R.one_to_one(i, items(spark, d).where("size < 45").select("tag"), "tag")


# ---- graphs


def g01(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 == 0, "scored").when(F.col("p_size") % 4 == 1, "pass").otherwise("other").alias("role"))
    direct, met = G.asset_links(nodes, links(spark, d))
    return direct.select(F.lit("direct").alias("kind"), "a", "b").unionByName(met.select(F.lit("through").alias("kind"), F.col("junction").alias("a"), F.col("id").alias("b")))


def g01_components(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    return G.components(G.both_ways(e).select(F.col("a").alias("id")).distinct(), e)


def g02(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return G.hops(starts, links(spark, d), 3)


def g02_nearest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return G.nearest_of(p.select(F.col("p_partkey").alias("id")), p.where("p_size = 7").select(F.col("p_partkey").alias("id")), links(spark, d), 4)


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    return links(spark, d).withColumn("network", (F.col("a") + F.col("b")) % 7)


def g03(spark: SparkSession, d: str) -> DataFrame:
    """Segments between items and junctions, and the arms of each junction."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 == 0).alias("item"))
    segments, arms = P.contract(nodes, _drawn(spark, d))
    return segments.select(F.lit("segment").alias("kind"), "a", "b", F.col("network").alias("n")).unionByName(arms.select(F.lit("junction").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("arms").alias("n")))


def g04(spark: SparkSession, d: str) -> DataFrame:
    """Networks of the links, where every third size is a junction."""
    return P.networks(links(spark, d), table(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("id")))


def g04_classes(spark: SparkSession, d: str) -> DataFrame:
    """Contracted links by what they are: pipe with its taps, instrument lines, stems, stubs, and junctions by kind.

    Of the items, a third are instruments, and some are actuators or nozzles of the item they hang on.
    """
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 < 3).alias("item"), F.col("p_size"))
    segments, arms = P.contract(part.select("id", "item"), _drawn(spark, d))
    items_ = part.where("item")
    ends = segments.join(items_.select(F.col("id").alias("a"), F.col("p_size").alias("s")), "a").join(items_.select(F.col("id").alias("b")), "b").groupBy(F.col("a").alias("id"), "s").agg(F.min("b").alias("of"))
    role = F.when(F.col("p_size") % 3 == 0, "instrument").when(F.col("p_size") % 7 == 1, "actuator").when(F.col("p_size") % 7 == 2, "nozzle")
    roles = items_.join(ends.select("id", "of"), "id", "left").select("id", role.alias("role"), F.when(role != "instrument", F.col("of")).alias("of")).where("role = 'instrument' or of is not null")
    pipe, others, kinds = P.classify(segments, arms, roles)
    rows = [
        pipe.select(F.lit("pipe").alias("line"), F.col("a").alias("start"), F.col("b").alias("end"), F.array_join("taps", "-").alias("detail")),
        others.select("line", "start", "end", F.lit("").alias("detail")),
        kinds.select(F.lit("junction").alias("line"), F.col("id").alias("start"), F.lit(None).cast("long").alias("end"), F.concat_ws(" ", "kind", "arms").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, rows)


def g05(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stream"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("tier"), F.when(F.col("l_quantity") > 15, 1).otherwise(-1).alias("sign"))
    return G.combined_directions(ev)


def g05_valves(spark: SparkSession, d: str) -> DataFrame:
    known = g05(spark, d).where("stream % 3 = 0")
    valves = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.min("l_orderkey").alias("x"), F.max("l_orderkey").alias("y")).where("x <> y")
    ends = valves.select(F.concat_ws("-", "p", "s").alias("valve"), F.explode(F.array("x", "y")).alias("stream"))
    return G.propagated(known, ends)


def g06(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_size % 10 = 0").select(F.col("p_partkey").alias("id"))
    e = links(spark, d).withColumn("weight", ((F.col("a") + F.col("b")) % 10 / 10.0).cast("double"))
    return G.shortest(p, p, e, 6).where("a < b").select("a", "b", "hop", F.array_join("path", "-").alias("path"), "least")


def g07(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d).select(F.floor(F.col("a") / 40).cast("long").alias("sheet"), F.floor(F.col("b") / 40).cast("long").alias("other"), F.when((F.col("a") + F.col("b")) % 5 == 0, "in").otherwise("out").alias("direction"))
    return G.sheet_edges(e)


def g08(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchy: region, nation, supplier as a path with its depth."""
    r, n, s = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier")
    top = r.select(F.col("r_name").alias("path"), F.lit(1).alias("depth"))
    mid = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"))
    low = s.join(mid, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "path", "s_name").alias("path"), F.lit(3).alias("depth"))
    return top.unionByName(mid.select("path", F.lit(2).alias("depth"))).unionByName(low)


def g09(spark: SparkSession, d: str) -> DataFrame:
    """A part feeds the one at twice its number; everything below each odd part."""
    p = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("a"))
    e = p.select("a", (F.col("a") * 2).alias("b")).join(p.select(F.col("a").alias("b")), "b", "left_semi")
    return G.descendants(e, p.where("a % 2 = 1").select(F.col("a").alias("id")))


# ---- ledgers, text and reports


def w13(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("decision_id"), "o_orderdate", "o_orderstatus")
    return R.latest(own, ["o_custkey"], ["o_orderdate", "decision_id"]).select("o_custkey", "decision_id", "previous", "o_orderstatus")


def l01(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    sheet = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, F.lit("erase")).when(F.col("o_orderkey") % 2 == 0, F.lit("correct")).otherwise(F.lit("confirm")).alias("action"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).when(F.col("o_orderkey") % 3 == 0, F.lit("BUILDING")).otherwise(F.lit("OTHER")).alias("value"))
    return R.apply_review(i, sheet).groupBy("outcome").agg(F.count("*").alias("n"))


def _models(spark: SparkSession, d: str) -> DataFrame:
    """A record for each sheet: its parts as instruments, and a controller each that measures the part and drives its neighbour."""
    own = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("long").alias("model"), "p_partkey", F.concat(F.lit("TI-"), (F.col("p_partkey") % 37).cast("string")).alias("tag"))
    row = F.struct("p_partkey", F.struct("tag").alias("i"), F.struct(F.concat(F.lit("C-"), "p_partkey").alias("tag"), F.col("tag").alias("measurement"), F.struct(F.array(F.lit("FV"), F.col("tag")).alias("split_range")).alias("output")).alias("c"))
    rows = own.groupBy("model").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # a sheet has forty parts
    return rows.select("model", F.to_json(F.struct(F.col("rows.i").alias("instruments"), F.col("rows.c").alias("controllers"))).alias("record"))


def _renames(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("long").alias("model")).distinct()
    asked = F.array(*[F.struct(F.lit("instruments").alias("section"), F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in (("TI-5", "TI-500"), ("TI-1", "TI-100"), ("TI-7", "TI-8"), ("TI-9", "C-1"))])
    return models.select("model", F.inline(asked))


def l02(spark: SparkSession, d: str) -> DataFrame:
    """Every place that names a renamed tag, and the renames that are refused."""
    changes, refused = N.planned(_models(spark, d), _renames(spark, d))
    return changes.select("model", F.col("path").alias("place"), "old", "new").unionByName(refused.select("model", F.col("why").alias("place"), "old", "new"))


def l02_applied(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the records once the renames are put back, counted by tag."""
    models = _models(spark, d)
    changes, _ = N.planned(models, _renames(spark, d))
    return N.index(N.applied(models, changes)).where("field <> 'controllers.tag'").groupBy("field", "value").agg(F.count("*").alias("n"))


def l03(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    sm = F.when(F.col("o_orderkey") % 4 == 0, "mismatch").when(F.col("o_orderkey") % 4 != 3, "match")
    pt = F.when(F.col("o_orderkey") % 3 == 0, "true").when(F.col("o_orderkey") % 3 == 1, "false")
    return o.groupBy(R.verdict_status(sm, pt).alias("status")).agg(F.count("*").alias("n"))


def l04(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 3 == 2, F.lit("needs_data")).otherwise(F.lit("accept")).alias("decision"), (F.length("text") % 2).cast("string").alias("value"))
    return R.register_state(own, "conv_id")


def f02(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    serial = F.col("event_id") % 1000 + 45000 + 0.25
    return e.select("event_id", T.hhmm(F.col("ts")).alias("hhmm"), T.excel_serial(serial).alias("serial_ts"), T.us_minute(F.date_format("ts", "M/d/yyyy H:mm")).alias("minute_ts"))


def f03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.digest("c_custkey", "c_name", "c_mktsegment", length=16).alias("digest"))


def f04(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.tokens(F.col("p_name")).alias("w"))
    n = p.select((F.col("id") + 1).alias("id"), F.col("w").alias("v"))
    return p.join(n, "id").select("id", T.jaccard(F.col("w"), F.col("v")).alias("similarity"))


def f05(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.significant(F.col("o_totalprice"), 3).alias("sig"))


def f06(spark: SparkSession, d: str) -> DataFrame:
    """Statement texts by template; equal statements are one, with the number of their targets."""
    o = table(spark, d, "orders").select(F.format_string("order priority %s has status %s", "o_orderpriority", "o_orderstatus").alias("text"), "o_orderkey")
    return o.groupBy("text").agg(F.count("*").alias("targets"), F.min("o_orderkey").alias("first")).withColumn("id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12))


def o01(spark: SparkSession, d: str) -> DataFrame:
    """Places of all items in the review order of their sheet."""
    i = items(spark, d).select("id", "sheet", F.when(F.col("size") > 40, "red").when(F.col("size") > 20, "amber").otherwise("green").alias("tier"), (F.col("size") / 50).alias("risk"), F.when(F.col("id") % 7 != 0, F.col("price")).alias("confidence"))
    w = Window.partitionBy("sheet").orderBy(*R.queue_order())
    return i.select("sheet", "id", "tier", F.row_number().over(w).alias("place"))


def o02(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([^/?]*)", 1).alias("section"), (F.length("html") % 97).alias("score"))
    return R.best_per_key(p, "section", "host", "score", "page_id", 8).select("section", "host", "page_id", "score", "place")


def o03(spark: SparkSession, d: str) -> DataFrame:
    return R.page(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "RING", ["p_name", "p_brand"], ["p_partkey"], 20, 40)


def o05_divergence(spark: SparkSession, d: str) -> DataFrame:
    """The first line at which an order's flags differ from its statuses."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") != F.col("l_linestatus"), F.col("l_linenumber"))).alias("first_line"))


def a20(spark: SparkSession, d: str) -> DataFrame:
    """Provenance by class: counts of each field's value, with totals."""
    p = table(spark, d, "part").select("p_type", "p_brand", F.col("p_size").cast("string").alias("size"))
    long = p.unpivot(["p_type"], ["p_brand", "size"], "field", "value")
    return long.rollup("p_type", "field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def a21(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("records"), F.count_if(F.col("o_orderstatus") == "P").alias("failures"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.max("o_totalprice").alias("largest")).where("o_orderpriority is not null")


def a22(spark: SparkSession, d: str) -> DataFrame:
    """Effort per arm: observed and missing tasks, sum and median."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'O'")
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("observed"), F.count_if(F.col("o_orderkey").isNull()).alias("missing"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.median("o_totalprice").alias("median"))


def a29(spark: SparkSession, d: str) -> DataFrame:
    """Setpoints against means: relative difference per series."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(C.steady_mean("value").alias("mean"), F.max_by("value", "event_id").alias("setpoint"))
    return C.setpoint_offsets(e, 0.5).select("user_id", "event_type", "off")


def a30(spark: SparkSession, d: str) -> DataFrame:
    """Worst relative imbalance per part: returned minus other quantities."""
    return C.imbalance(table(spark, d, "lineitem").select("l_partkey", (F.col("l_returnflag") == "R").alias("outlet"), F.col("l_quantity").alias("quantity")), ["l_partkey"])


def a31(spark: SparkSession, d: str) -> DataFrame:
    """Status matrix: inputs by row, with single-source inputs."""
    o = table(spark, d, "orders").withColumn("family", F.col("o_custkey") % 40)
    return o.groupBy("family").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).join(o.groupBy("family").agg(F.count_distinct("o_orderpriority").alias("sources")), "family")


def _screened(spark: SparkSession, d: str) -> DataFrame:
    """Lines as screens: a supplier's nation is a site, a flag and line number a question, and an order that is much discounted a finding."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("site"))
    return table(spark, d, "lineitem").join(s, "l_suppkey").select("site", F.concat("l_returnflag", "l_linenumber").alias("question"), F.col("l_orderkey").alias("finding"), (F.col("l_discount") > 0.09).alias("fires"), F.col("l_linestatus").alias("item"), (F.col("l_partkey") % 3).alias("place"), "l_quantity")


def a32(spark: SparkSession, d: str) -> DataFrame:
    """Per question the sites where it fired, was quiet, could not be checked and was not run."""
    own = _screened(spark, d)
    ran = own.where("site % 7 <> 0 or question <> 'R3'").groupBy("site", "question").agg(F.max("fires").alias("fires"), F.max("l_quantity").alias("most"))
    status = F.when(F.col("fires"), "fired").when(F.col("site") % 3 == 0, "not checked").otherwise("quiet")
    found = Q.site_rollup(ran.select("site", "question", status.alias("status")), own.where("fires and (site % 7 <> 0 or question <> 'R3')").select("site", "question", "finding"))
    joined = lambda c: F.array_join(c, " ").alias(c)
    return found.select("question", "fired", "findings", *map(joined, ("fired_at", "quiet_at", "not_checked_at", "not_run_at")), "place")


def a32_requests(spark: SparkSession, d: str) -> DataFrame:
    """Places where data is asked for, those of all findings of a site once."""
    return Q.merged_requests(_screened(spark, d).where("fires").select("site", "question", "finding", "item", "place"))


def a33(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.agg(F.count("*").alias("checks"), F.count_if(F.col("l_discount") <= 0.05).alias("passed"), F.count_if(F.col("l_tax").isNull()).alias("not_checked"))


def a34(spark: SparkSession, d: str) -> DataFrame:
    """Staging rows: duplicate names under a parent and orphan parents."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 60).alias("parent"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return C.staging_findings(p, table(spark, d, "supplier").where("s_suppkey < 55").select(F.col("s_suppkey").alias("parent")))


def a35(spark: SparkSession, d: str) -> DataFrame:
    """Energy and cost ranges of lines as changes, summed per order status; a seventh line gives its power twice, and much discounted ones have no range of hours."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = lambda lo, hi: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    left = 0.05 - F.col("l_discount")
    given = F.create_map(F.lit("kw"), both(F.col("l_quantity") * 0.9, F.col("l_quantity") * 1.1), F.lit("hours"), both(1000 * left, 2000 * left), F.lit("price_per_kwh"), both(F.lit(0.1), F.lit(0.12)))
    twice = F.create_map(F.lit("hp"), both(F.col("l_quantity"), F.col("l_quantity")))
    changes = li.select("o_orderstatus", F.when(F.col("l_linenumber") == 7, F.map_concat(given, twice)).otherwise(given).alias("given"))
    found = impact.totals(impact.resolved(changes), ["o_orderstatus"], ("kwh", "cost_electricity"))
    return found.select("o_orderstatus", "measure", "changes", "refused", F.round("lo", 1).alias("lo"), F.round("hi", 1).alias("hi"))


def a36(spark: SparkSession, d: str) -> DataFrame:
    """Tags on more than one item."""
    return C.shared_tags(items(spark, d)).groupBy("kind").agg(F.count("*").alias("items"), F.count_distinct("tag").alias("tags"))


def k01(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the portable graph with ids in section and item order."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    part_of = s.select(F.lit(1).alias("section"), F.col("s_suppkey").cast("long").alias("item"), F.lit("part_of").alias("type"), F.concat(F.lit("S"), "s_suppkey").alias("from"), F.concat(F.lit("N"), "s_nationkey").alias("to"))
    within = n.select(F.lit(2).alias("section"), F.col("n_nationkey").cast("long").alias("item"), F.lit("within").alias("type"), F.concat(F.lit("N"), "n_nationkey").alias("from"), F.concat(F.lit("R"), "n_regionkey").alias("to"))
    edges = part_of.unionByName(within)
    # Ids are consecutive within a section; a section's number leads, so no window spans all edges.
    return edges.select(F.format_string("E%d-%06d", "section", F.row_number().over(Window.partitionBy("section").orderBy("item"))).alias("id"), "type", "from", "to")


def k01_bundle(spark: SparkSession, d: str) -> DataFrame:
    """The graph of regions, nations, suppliers and parts, written as a bundle and read back: what each kind holds."""
    p, s, n = table(spark, d, "part"), table(spark, d, "supplier"), table(spark, d, "nation")
    node = lambda df, mark, key, kind, label: df.select(F.concat(F.lit(mark), key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"), F.lit("verified").alias("status"))
    nodes = node(n, "N", "n_nationkey", "nation", "n_name").unionByName(node(s, "S", "s_suppkey", "supplier", "s_name")).unionByName(node(p.where("p_size > 1"), "P", "p_partkey", "part", "p_name")).unionByName(node(s.where("s_suppkey % 10 = 0"), "S", "s_suppkey", "tank", "s_name"))
    edge = lambda df, section, item, kind, a, b: df.select(F.lit(section).alias("section"), F.col(item).cast("long").alias("item"), F.when(F.col(item) % 5 == 0, F.concat(F.lit(f"own-{section}-"), item)).alias("id"), F.lit(kind).alias("type"), a.alias("from"), b.alias("to"), F.lit("unknown").alias("status"))
    of = lambda mark, key: F.concat(F.lit(mark), key)
    edges = edge(s, 1, "s_suppkey", "part_of", of("S", "s_suppkey"), of("N", "s_nationkey")).unionByName(edge(n, 2, "n_nationkey", "within", of("N", "n_nationkey"), of("R", "n_regionkey"))).unionByName(edge(p, 3, "p_partkey", "follows", of("P", "p_partkey"), of("P", F.col("p_partkey") + 1)))
    claims = p.select(of("P", "p_partkey").alias("item"), F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value"), F.lit("list").alias("source"))
    events = table(spark, d, "orders").select(of("S", F.col("o_custkey") % 20).alias("item"), F.col("o_orderstatus").alias("decision"), F.col("o_orderpriority").alias("by"), F.col("o_orderdate").alias("on"))
    path = new_path(spark, "graph")
    sinks.graph(nodes, edges, claims, events, path)
    g = sinks.read_graph(spark, path)
    count = lambda name, by, least: g[name].groupBy(F.lit(name).alias("record"), F.col(by).alias("type")).agg(F.count("*").alias("n"), F.min(least).alias("first"))
    rows = [count("nodes", "type", "id"), count("edges", "type", "id"), count("claims", "name", "item"), count("events", "decision", "item"), g["not_exported"].groupBy(F.concat_ws(" ", F.lit("not_exported"), "kind").alias("record"), F.col("why").alias("type")).agg(F.count("*").alias("n"), F.min("id").alias("first"))]
    return reduce(DataFrame.unionByName, rows)


def k02(spark: SparkSession, d: str) -> DataFrame:
    """Review rows: joined reasons and guarded cells."""
    i = items(spark, d)
    why = F.array_join(F.array_compact(F.array(F.when(F.col("size") > 40, "large"), F.when(F.col("price") < 950, "cheap"), F.when(F.col("tag").startswith("PSV"), "relief"))), "; ")
    return i.select("id", T.guarded(F.concat(F.when(F.col("id") % 5 == 0, F.lit("=")).otherwise(F.lit("")), "tag")).alias("cell"), why.alias("why"))


def k03(spark: SparkSession, d: str) -> DataFrame:
    """Staging rows, templates before elements before attributes."""
    i = items(spark, d)
    t = i.select(F.lit(0).alias("level"), F.lit("").alias("parent"), F.col("kind").alias("name")).distinct()
    e = i.select(F.lit(1).alias("level"), F.col("kind").alias("parent"), F.concat("tag", F.lit("#"), F.col("id").cast("string")).alias("name"))
    a = i.select(F.lit(2).alias("level"), F.concat("tag", F.lit("#"), F.col("id").cast("string")).alias("parent"), F.lit("size").alias("name"))
    return t.unionByName(e).unionByName(a).orderBy("level", "parent", "name")


def k04(spark: SparkSession, d: str) -> DataFrame:
    """Tag tree: the tags of each unit as JSON lines, written and read back."""
    path = new_path(spark, "tags")
    sinks.documents(items(spark, d).groupBy("unit", "sheet").agg(F.array_sort(F.collect_list("tag")).alias("tags")), path)  # a sheet holds 40 items
    return spark.read.schema("unit long, sheet long, tags array<string>").json(path).select("unit", "sheet", F.to_json("tags").alias("tags"))


def s18(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes with line ends made one."""
    return table(spark, d, "pages").select("page_id", F.sha2(F.regexp_replace("html", "\r\n", "\n").cast("binary"), 256).alias("hash"), F.octet_length("html").alias("bytes"))


PLANT = """WITH m AS (
  SELECT p_partkey AS id, p_partkey % 5 AS k, (['FIC', 'TI', 'PSV', 'LAHH', 'K'])[p_partkey % 5 + 1] || '-' || p_partkey AS tag, (['FIC', 'TI', 'PSV', 'LAHH', 'K'])[p_partkey % 5 + 1] || p_partkey AS key, p_name AS text,
    CASE WHEN p_partkey % 5 <> 4 AND p_partkey % 17 <> 0 AND p_partkey - p_partkey % 5 + 4 IN (SELECT p_partkey FROM part) THEN p_partkey - p_partkey % 5 + 4 END AS unit, p_partkey // 10 AS stream,
    list_filter([CASE WHEN contains(p_name, 'hot') THEN 'hot' END, CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'colour' END, CASE WHEN regexp_matches(p_name, 'small|large') THEN 'size' END], lambda x: x IS NOT NULL) AS media,
    CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 0 THEN 'PSV' || (p_partkey + 2) END AS outputs,
    CASE WHEN p_partkey % 5 = 0 AND p_partkey % 4 <> 0 THEN 'TI' || (p_partkey + 1) WHEN p_partkey % 5 = 3 AND p_partkey % 3 = 0 THEN 'TI' || (p_partkey - 2) END AS reads
  FROM part),
e AS (SELECT x.id // 10 AS stream, x.id AS src, y.id AS dst FROM m x JOIN m y ON y.id = x.id + 5 WHERE x.id % 10 = 4),
a AS (SELECT * FROM m WHERE k IN (1, 2))"""
_E = "b.{0} = a.{0} AND b.id <> a.id"
QUERIES = {
    "p01_tag_spellings": (p01, """WITH t AS (SELECT s_suppkey AS id, ' ' || substr(s_name, 1, 3) || '_-/ .' || substr(s_name, 10, 9) AS t FROM supplier)
      SELECT id, upper(regexp_replace(t, '\\s+', '', 'g')) AS strict, regexp_replace(upper(t), '[^A-Z0-9]', '', 'g') AS lenient, upper(regexp_replace(t, '[\\s_\\-./]', '', 'g')) AS mapped,
        upper(regexp_replace(t, '[\\s\\-_]', '', 'g')) AS compact, upper(regexp_replace(trim(t), '[\\s\\-_]+', '-', 'g')) AS screen FROM t"""),
    "p01_nfkc": (p01_nfkc, None),
    "p02_isa_parts": (p02, I_ + """SELECT id, regexp_extract(tag, '^([A-Z]+)', 1) AS letters, regexp_extract(tag, '-([0-9]+)$', 1) AS loop,
      CASE substr(tag, 1, 1) WHEN 'F' THEN 'flow' WHEN 'T' THEN 'temperature' WHEN 'P' THEN 'pressure' WHEN 'L' THEN 'level' WHEN 'X' THEN 'unclassified' END AS variable, tag LIKE 'LA%' OR tag LIKE 'XV%' AS plant_coded FROM items"""),
    "p03_offpage_refs": (p03, """SELECT p_partkey AS id, 'PD-' || lpad(p_partkey::VARCHAR, 4, '0') AS ref, 'PD' AS code,
      array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' PD-' || lpad(p_partkey::VARCHAR, 4, '0')), '[a-z0-9]+'), lambda w: NOT list_contains(['to','from','the','of','and','for','see','dwg','drawing','sheet'], w)))), ' ') AS words FROM part"""),
    "p04_selector": (p04, I_ + "SELECT id, tag, kind FROM items WHERE kind IN ('economy', 'standard') AND regexp_matches(tag, '^(FIC|TI)') AND NOT tag LIKE '%0' AND price >= 920 AND size <= 40"),
    "p05_rejections": (p05, I_ + "SELECT id, tag FROM items WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) AND tag NOT LIKE 'LAHH%'"),
    "p06_nested_claims": (p06, """SELECT event_id AS owner, u.name, u.value FROM (SELECT event_id, unnest([{'name': 'props.k', 'value': (props::JSON->>'$.k')}, {'name': 'tags[0]', 'value': event_type}, {'name': 'tags[1]', 'value': 'x'}, {'name': 'user', 'value': user_id::VARCHAR}]) AS u FROM events)"""),
    "p07_status_source": (p07, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'verified' WHEN o_orderkey % 7 = 0 THEN 'topology' ELSE 'unverified' END AS status, CASE WHEN regexp_matches(o_orderpriority, 'URGENT|HIGH') THEN 'expert' ELSE 'machine' END AS track FROM orders"),
    "p08_profile_dropped": (p08, "SELECT l_returnflag || '.' || l_linestatus AS name, count(*) AS dropped FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1"),
    "p09_roles": (p09, I_ + "SELECT id, CASE WHEN regexp_matches(tag, '^(FIC|TI)') THEN 'instrument' WHEN regexp_matches(tag, '^(PSV|XV)') THEN 'line_item' WHEN kind = 'promo' THEN 'offpage' ELSE 'equipment' END AS role FROM items"),
    "p10_safety_floor": (p10, I_ + """, f AS (SELECT CASE WHEN tag LIKE 'PSV%' THEN 'relief' WHEN tag LIKE 'XV%' THEN 'shutdown' WHEN tag LIKE 'LAHH%' THEN 'trip' END AS function, CASE WHEN size < 20 THEN 'green' ELSE 'amber' END AS tier FROM items)
      SELECT function, tier, CASE WHEN function IS NOT NULL AND tier = 'green' THEN 'amber' ELSE tier END AS floor, count(*) AS n FROM f GROUP BY ALL"""),
    "p11_isolation_points": (p11, I_ + ", " + LINKS.strip() + """, d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
      k AS (SELECT i.id, CASE WHEN tag LIKE 'XV%' THEN 'operated' WHEN coalesce(degree, 0) >= 3 THEN 'branch' WHEN degree = 2 THEN 'inline' END AS point, coalesce(degree, 0) AS degree FROM items i LEFT JOIN d USING (id)) SELECT * FROM k WHERE point IS NOT NULL"""),
    "p12_purpose": (p12, "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN contains(p_name, 'ring') THEN p_name ELSE p_brand END AS purpose, CASE WHEN p_partkey % 3 = 0 THEN 'schedule' WHEN contains(p_name, 'ring') THEN 'drawing' ELSE 'tag' END AS source FROM part"),
    "p13_field_state": (p13, "SELECT CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'blank' WHEN o_orderkey % 11 <> 0 THEN 'present' ELSE 'absent' END AS state, count(*) AS n FROM orders GROUP BY 1"),
    "p15_three_state_rules": (p15, """SELECT rule, event_type, CASE WHEN value IS NULL THEN 'no reading' WHEN side = 'below' THEN CASE WHEN value + 1 < lim THEN 'met' WHEN value - 1 >= lim THEN 'clear' ELSE 'uncertain' END
      ELSE CASE WHEN value - 1 > lim THEN 'met' WHEN value + 1 <= lim THEN 'clear' ELSE 'uncertain' END END AS state, count(*) AS n FROM events, (VALUES ('low', 10.0, 'below'), ('high', 120.0, 'above')) AS r(rule, lim, side) GROUP BY ALL"""),
    "p16_channels": (p16, I_ + "SELECT id, CASE WHEN g.range > 1 THEN tag || '-' || g.range ELSE tag END AS channel, (g.range - 1)::INTEGER AS pos FROM items, range(1, 4) g WHERE tag LIKE 'TI-%' AND g.range <= size % 3 + 1"),
    "p17_bulk_rename": (p17, I_ + ", m AS (SELECT tag AS old FROM items WHERE id < 40) SELECT id, CASE WHEN old IS NULL THEN tag ELSE 'N-' || tag END AS tag, old AS former_tag FROM items LEFT JOIN m ON old = tag"),
    "p18_unit_findings": (p18, I_ + """, u AS (SELECT id, CASE size % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'kPa' END AS own, CASE kind WHEN 'economy' THEN 'bar' WHEN 'standard' THEN 'kPa' END AS k FROM items)
      SELECT id, coalesce(own, k) AS uom, CASE WHEN own IS NULL AND k IS NULL THEN 'no unit' WHEN own <> k THEN 'units differ' END AS finding FROM u"""),
    "j02_point_mapping": (j02, I_ + """, l AS (SELECT c_custkey AS row, (['FIC', 'TI', 'PSV', 'LAHH', 'XV'])[c_custkey % 5 + 1] || '-' || (c_custkey * 3 % 900) AS tag FROM customer), c AS (SELECT tag, count(*) AS n, min(id) AS asset FROM items GROUP BY tag)
      SELECT l.tag, row, CASE WHEN n = 1 THEN asset END AS asset, CASE WHEN n IS NULL THEN 'not on drawing' WHEN n > 1 THEN 'ambiguous' ELSE 'mapped' END AS outcome FROM l LEFT JOIN c USING (tag)
      UNION ALL SELECT tag, NULL, id, 'not in list' FROM items WHERE tag NOT IN (SELECT tag FROM l)"""),
    "j03_identity_mapping": (j03, "SELECT CASE WHEN p_size IS NULL THEN 'unknown id' WHEN p_size = 13 THEN 'blocked' ELSE 'mapped' END AS outcome, l_returnflag, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 GROUP BY ALL"),
    "j04_change_feed": (j04, """WITH b AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 10 <> 3), a AS (SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 10 <> 4)
      SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, b.v AS before, a.v AS after
      FROM b FULL JOIN a ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.v IS DISTINCT FROM b.v"""),
    "j05_loop_audit": (j05, """WITH l AS (SELECT l_orderkey, coalesce(bool_or(p_size > 10) FILTER (l_linenumber = 1), false) AS controller, coalesce(bool_or(p_size > 10) FILTER (l_linenumber = 2), false) AS measurement, coalesce(bool_or(p_size > 10) FILTER (l_linenumber = 3), false) AS output
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 3 GROUP BY l_orderkey)
      SELECT controller, measurement, output, CASE controller::INT + measurement::INT + output::INT WHEN 3 THEN 'drawn' WHEN 0 THEN 'not drawn' ELSE 'partly' END AS status, count(*) AS loops FROM l GROUP BY ALL"""),
    "j05_signal_audit": (j05_signals, """WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part), h AS (SELECT k FROM p WHERE z % 10 <> 3),
      l AS (SELECT k AS loop, z, k % 35 = 0 AS combined, CASE WHEN k % 35 = 0 THEN k WHEN k % 15 = 0 THEN -1 ELSE k + 1 END AS m FROM p WHERE k % 5 = 0),
      c AS (SELECT loop, combined, loop IN (SELECT k FROM h) AS controller, m IN (SELECT k FROM h) AS measurement, loop + 2 IN (SELECT k FROM h) AS output,
        loop + 3 IN (SELECT k FROM h) AS f_out, loop + 4 IN (SELECT k FROM h) AS f_in, z FROM l),
      t AS (SELECT loop, combined, controller, measurement, output,
        (NOT combined AND controller AND measurement AND z % 4 <> 1) OR (combined AND controller) AS signal_in,
        controller AND ((output AND z % 3 = 0) OR (f_out AND z % 2 = 0 AND f_in AND output)) AS signal_out FROM c)
      SELECT *, CASE WHEN NOT controller THEN 'not_drawn' WHEN measurement AND output AND signal_in AND signal_out THEN 'drawn' ELSE 'partly_drawn' END AS status FROM t"""),
    "j06_loop_tags": (j06, I_ + """, t AS (SELECT DISTINCT replace(tag, '-', '') AS k FROM items), o AS (SELECT 'FIC' || (o_orderkey % 900) IN (SELECT k FROM t) AS c, 'TI' || (o_custkey % 900) IN (SELECT k FROM t) AS m FROM orders)
      SELECT CASE WHEN c AND m THEN 'tags_present' WHEN c OR m THEN 'partly' ELSE 'not found' END AS status, count(*) AS loops FROM o GROUP BY 1"""),
    "j07_loop_numbering": (j07, "SELECT numbers = 1 AS one_number, tags, count(*) AS loops FROM (SELECT l_orderkey, count(DISTINCT l_partkey % 700) AS numbers, count(*) AS tags FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) GROUP BY ALL"),
    "j08_connector_pairs": (j08, None),
    "j09_drawing_numbers": (j09, None),
    "j09_sheet_identity": (j09_codes, """WITH p AS (SELECT floor(p_partkey / 40)::BIGINT AS sheet, p_brand, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY sheet) AS most FROM p)
      SELECT sheet, CASE WHEN count(*) = 1 THEN min(p_brand) ELSE 'unknown' END AS system, any_value(n) AS n FROM t WHERE n = most GROUP BY sheet"""),
    "j13_relations": (j13, I_ + """SELECT anchor, relation, count(*) AS n FROM (SELECT a.id AS anchor, 'same_unit' AS relation FROM items a JOIN items c ON a.unit = c.unit WHERE a.tag LIKE 'PSV%' AND c.tag LIKE 'XV%'
      UNION ALL SELECT a.id, 'other_unit' FROM items a JOIN items c ON a.sheet = c.sheet AND a.unit <> c.unit WHERE a.tag LIKE 'PSV%' AND c.tag LIKE 'XV%') GROUP BY ALL"""),
    "j14_rule_questions": (j14, I_ + f"""SELECT 'q1' AS question, sheet::VARCHAR AS place, count(*) AS anchors, min(tag) AS first_tag FROM items a WHERE tag LIKE 'PSV%' AND EXISTS (SELECT 1 FROM items b WHERE {_E.format('sheet')} AND b.tag LIKE 'FIC%')
        AND NOT EXISTS (SELECT 1 FROM items b WHERE {_E.format('sheet')} AND b.tag LIKE 'LAHH%' AND b.size >= 30) GROUP BY sheet
      UNION ALL SELECT 'q2', unit::VARCHAR, count(*), min(tag) FROM items a WHERE tag LIKE 'TI%' AND price >= 905 AND EXISTS (SELECT 1 FROM items b WHERE {_E.format('unit')} AND b.tag LIKE 'TI%' AND b.size <= 5) GROUP BY unit HAVING count(*) >= 2"""),
    "j13_relation_kinds": (j13_relations, PLANT + """, q AS (
        SELECT 'same_stream' AS relation, a.id AS anchor, c.id FROM a JOIN m c ON c.stream = a.stream
        UNION SELECT 'same_unit', a.id, c.id FROM a JOIN m c ON c.unit = a.unit OR c.id = a.unit
        UNION SELECT 'same_unit_same_medium', a.id, c.id FROM a JOIN m c ON (c.unit = a.unit OR (a.unit IS NOT NULL AND c.stream = a.stream)) AND list_has_any(a.media, c.media)
        UNION SELECT 'drives', a.id, c.id FROM a JOIN m c ON c.outputs = a.key
        UNION SELECT 'reads', a.id, c.id FROM a JOIN m c ON c.reads = a.key
        UNION SELECT 'linked', a.id, c.id FROM a JOIN e ON a.unit IN (e.src, e.dst) JOIN m c ON (c.k <> 4 AND c.stream = e.stream) OR (c.k = 4 AND c.id IN (e.src, e.dst) AND c.id <> a.unit)
        UNION SELECT 'discharge_side', a.id, c.id FROM a JOIN e ON a.unit = e.src JOIN m c ON c.stream = e.stream),
      h AS (SELECT * FROM m WHERE k = 2 AND text LIKE 'hot ring%')
      SELECT relation, count(DISTINCT anchor) AS anchors, count(*) AS pairs FROM q WHERE anchor <> id GROUP BY relation
      UNION ALL SELECT 'anywhere', count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.id <> a.id)), NULL FROM a
      UNION ALL SELECT 'other_unit', count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.id <> a.id AND h.unit <> a.unit)), NULL FROM a"""),
    "j14_rules": (j14_rules, PLANT + """, v AS (
        SELECT *, coalesce(unit, id) AS place FROM a WHERE k = 2 AND contains(text, 'hot') AND EXISTS (SELECT 1 FROM m c WHERE c.outputs = a.key) AND NOT EXISTS (SELECT 1 FROM m c WHERE c.k = 3 AND c.unit = a.unit AND contains(c.text, 'small'))),
      r AS (SELECT v.*, CASE WHEN unit IS NOT NULL THEN (SELECT regexp_matches(x.text, 'bolt|rod') FROM m x WHERE x.id = v.unit)
        ELSE coalesce((SELECT bool_and(regexp_matches(x.text, 'bolt|rod')) FROM e JOIN m x ON x.id IN (e.src, e.dst) WHERE e.stream = v.stream), false) END AS gone FROM v),
      w AS (SELECT * FROM r WHERE place NOT IN (SELECT place FROM r GROUP BY place HAVING bool_and(gone))),
      i AS (SELECT a.* FROM a WHERE k = 1 AND EXISTS (SELECT 1 FROM m c WHERE c.reads = a.key) AND EXISTS (SELECT 1 FROM m h WHERE h.k = 3 AND h.text LIKE 'hot ring%' AND h.unit <> a.unit))
      SELECT 'r1' AS question, place::VARCHAR AS place, count(*) AS anchors, min(tag) AS first_tag, (SELECT count(DISTINCT c.id) FROM w x JOIN m c ON c.stream = x.stream AND c.k = 1 WHERE x.place = w.place)::BIGINT AS shown FROM w GROUP BY place
      UNION ALL SELECT 'r2', NULL, count(*), min(tag), 0 FROM i HAVING count(*) >= 2"""),
    "j02_mapping_plan": (j02_plan, """WITH i AS (SELECT p_partkey AS id, regexp_replace('FIC-' || (p_partkey - p_partkey % 10), '[\\s_\\-./]', '', 'g') AS key, p_partkey % 10 = 5 AS tagged FROM part WHERE p_partkey % 7 <> 0),
      t AS (SELECT key, count(*) AS n, min(id) AS id FROM i WHERE tagged GROUP BY key),
      r AS (SELECT o_orderkey AS row, 'FIC' || (o_orderkey * 5 % 4000) AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 1200 END AS pin, o_orderkey % 11 <> 0 AS addressed FROM orders),
      j AS (SELECT r.*, i.id AS pinned, t.n, t.id AS by_tag FROM r LEFT JOIN i ON i.id = r.pin LEFT JOIN t ON t.key = r.key),
      f AS (SELECT *, CASE WHEN NOT addressed THEN 'refused: address is blank' WHEN pin IS NOT NULL AND pinned IS NULL THEN 'refused: unknown or rejected asset id' WHEN pin IS NULL AND n IS NULL THEN 'not on drawing' WHEN pin IS NULL AND n > 1 THEN 'ambiguous' ELSE 'mapped' END AS o,
        CASE WHEN pin IS NOT NULL THEN pinned WHEN n = 1 THEN by_tag END AS asset FROM j),
      x AS (SELECT *, CASE WHEN o = 'mapped' AND row_number() OVER (PARTITION BY o, asset ORDER BY row) > 1 THEN 'refused: target given twice' ELSE o END AS outcome FROM f)
      SELECT outcome, count(*) AS n, sum(CASE WHEN outcome = 'mapped' THEN asset END)::BIGINT AS assets FROM x GROUP BY outcome
      UNION ALL SELECT 'not in list', count(*), sum(id)::BIGINT FROM i WHERE id NOT IN (SELECT asset FROM x WHERE outcome = 'mapped') HAVING count(*) > 0"""),
    "j25_topology_repair": (j25_repair, """WITH al AS (SELECT DISTINCT s_suppkey % 400 AS number, s_suppkey % 40 AS a, s_suppkey % 40 + 1 AS b FROM supplier UNION SELECT s_suppkey % 400, s_suppkey % 40, s_suppkey % 40 + 2 FROM supplier WHERE s_suppkey % 5 = 0),
      s AS (SELECT s_suppkey AS id, s_suppkey % 400 + CASE WHEN s_suppkey % 29 = 3 THEN 1000 ELSE 0 END AS number, s_suppkey % 40 AS x, s_suppkey % 40 + 1 AS y, s_suppkey % 7 AS h FROM supplier),
      d AS (SELECT id, number, CASE h WHEN 1 THEN y WHEN 2 THEN x + 50 WHEN 4 THEN x + 60 ELSE x END AS a, CASE h WHEN 1 THEN x WHEN 3 THEN y + 50 WHEN 4 THEN y + 60 ELSE y END AS b FROM s),
      c AS (SELECT d.*, (SELECT count(*) FROM al WHERE al.number = d.number AND al.a = d.a AND al.b = d.b) AS same, (SELECT count(*) FROM al WHERE al.number = d.number AND al.a = d.b AND al.b = d.a) AS turned,
        (SELECT count(*) FROM al WHERE al.number = d.number AND (al.a = d.a OR al.b = d.b)) AS fits,
        (SELECT max(CASE WHEN al.a <> d.a THEN 'from ' || al.a ELSE 'to ' || al.b END) FROM al WHERE al.number = d.number AND (al.a = d.a OR al.b = d.b)) AS one FROM d)
      SELECT result, fix, count(*) AS n FROM (SELECT CASE WHEN same > 0 THEN 'confirmed' WHEN turned > 0 OR fits = 1 THEN 'corrected' ELSE 'unresolvable' END AS result, CASE WHEN same > 0 THEN NULL WHEN turned > 0 THEN 'reversed' WHEN fits = 1 THEN one END AS fix FROM c) GROUP BY ALL"""),
    "j15_data_requests": (j15, I_ + """SELECT * FROM (SELECT sheet AS place, 'service' AS field, count(*) AS subjects, count(*) FILTER (size % 5 = 0) AS still_needed FROM items GROUP BY sheet
      UNION ALL SELECT sheet, 'rating', count(*), count(*) FILTER (size % 3 = 0) FROM items GROUP BY sheet) WHERE still_needed > 0"""),
    "j16_integrity": (j16, """SELECT 'duplicate line' AS "check", l_orderkey || '-' || l_linenumber AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
      UNION ALL SELECT DISTINCT 'dangling order', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT DISTINCT 'dangling part', l_partkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
      UNION ALL SELECT DISTINCT 'dangling customer', o_custkey::VARCHAR FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'unknown status', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus NOT IN ('O', 'F')"""),
    "j17_model_diff": (j17, I_ + """SELECT status, count(*) AS n FROM (SELECT CASE WHEN unit % 9 = 4 THEN 'missing' WHEN unit % 10 = 1 AND kind <> 'other' THEN 'wrong role' WHEN unit % 11 = 1 THEN 'fields differ' ELSE 'ok' END AS status FROM items
      UNION ALL SELECT 'extra' FROM range(3)) GROUP BY status"""),
    "j18_multiset_compare": (j18, "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity <= 3"),
    "j19_claim_check": (j19, """SELECT 'colour' AS name, 'no field' AS result, count(*) AS n FROM part UNION ALL SELECT 'size', 'equal', count(*) FROM part
      UNION ALL SELECT 'brand', CASE WHEN p_partkey % 9 = 0 AND p_brand <> 'Brand#0' THEN 'differs' ELSE 'equal' END, count(*) FROM part GROUP BY 2"""),
    "j24_source_names": (j24, """WITH w AS (SELECT p_partkey AS id, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part)
      SELECT CASE WHEN s.w IS NULL THEN 'unverified' WHEN list_has_any(a.w, s.w) THEN 'confirmed' ELSE 'corrected' END AS result, count(*) AS n FROM w a LEFT JOIN w s ON s.id + 1 = a.id GROUP BY 1"""),
    "j25_topology_check": (j25, """WITH s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 ELSE s_nationkey END AS a, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey ELSE s_nationkey % 5 END AS b FROM supplier)
      SELECT CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = a AND n_regionkey = b) THEN 'confirmed' WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = b AND n_regionkey = a) THEN 'corrected' ELSE 'unresolvable' END AS result, count(*) AS n FROM s GROUP BY 1"""),
    "j27_shared_network": (j27, """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.p AS a, y.p AS b, min(x.o) AS network FROM l x JOIN l y ON x.o = y.o AND x.p < y.p AND x.p // 40 = y.p // 40 GROUP BY ALL HAVING count(DISTINCT x.o) = 1"""),
    "j30_live_movement": (j30, """SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, arg_min(value, (ts, event_id)) <> arg_max(value, (ts, event_id)) AS moved FROM events GROUP BY ALL"""),
    "j31_quality_checks": (j31, "SELECT event_type, CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE 'good' END AS quality, count(*) AS n, count(*) FILTER (value < 0 OR value > 200) AS out_of_range FROM events GROUP BY ALL"),
    "j32_registered_claims": (j32, "SELECT DISTINCT o_orderpriority, o_orderpriority <> '5-LOW' AS holds FROM orders"),
    "j33_freshness": (j33, """WITH RECURSIVE p AS (SELECT p_partkey AS s, p_name FROM part WHERE p_partkey > 0),
      o AS (SELECT s, CASE WHEN s % 17 = 0 THEN 'NEVER BUILT' WHEN s % 19 = 0 THEN 'MISSING' WHEN s % 23 = 0 THEN 'STALE' ELSE 'FRESH' END AS state FROM p WHERE s % 17 <> 0 OR s % 19 <> 0),
      d AS (SELECT s * 2 AS s FROM o WHERE state <> 'FRESH' AND s * 2 IN (SELECT s FROM p) UNION SELECT s * 2 FROM d WHERE s * 2 IN (SELECT s FROM p))
      SELECT s AS stage, CASE WHEN state = 'FRESH' AND s IN (SELECT s FROM d) THEN 'STALE' ELSE state END AS state FROM o"""),
    "j34_one_to_one": (j34, I_ + """, i AS (SELECT tag, count(*) AS n FROM items WHERE size > 5 GROUP BY tag), t AS (SELECT tag, count(*) AS n FROM items WHERE size < 45 GROUP BY tag)
      SELECT tag, coalesce(i.n, 0) AS items, coalesce(t.n, 0) AS tags, CASE WHEN t.n IS NULL THEN 'no tag' WHEN i.n IS NULL THEN 'no item' ELSE 'not one to one' END AS finding FROM i FULL JOIN t USING (tag) WHERE coalesce(i.n, 0) <> 1 OR coalesce(t.n, 0) <> 1"""),
    "g01_asset_links": (g01, RL + """, n AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'scored' WHEN 1 THEN 'pass' ELSE 'other' END AS role FROM part),
      e AS (SELECT l.a, l.b, x.role AS ra, y.role AS rb FROM (SELECT a, b FROM links UNION SELECT b, a FROM links) l JOIN n x ON x.id = l.a JOIN n y ON y.id = l.b),
      w AS (SELECT id, id AS root FROM n WHERE role = 'pass' UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id AND e.rb = 'pass'),
      c AS (SELECT id, min(root) AS root FROM w GROUP BY id),
      t AS (SELECT DISTINCT root, e.b AS id FROM c JOIN e ON e.a = c.id AND e.rb = 'scored')
      SELECT 'direct' AS kind, a, b FROM e WHERE ra = 'scored' AND rb = 'scored' AND a < b
      UNION ALL SELECT 'through', root, id FROM t WHERE root IN (SELECT root FROM t GROUP BY root HAVING count(*) > 1)"""),
    "g01_components": (g01_components, RL + """, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), w AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id WHERE w.root < e.b)
      SELECT id, min(root) AS root FROM w GROUP BY id"""),
    "g02_hops": (g02, RL + """, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), w AS (SELECT p_partkey AS start, p_partkey AS id, 0 AS hop FROM part UNION SELECT w.start, e.b, hop + 1 FROM w JOIN e ON e.a = w.id WHERE hop < 3)
      SELECT start, id, min(hop)::INTEGER AS hop FROM w GROUP BY ALL"""),
    "g02_nearest": (g02_nearest, RL + """, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), w AS (SELECT p_partkey AS start, p_partkey AS id, 0 AS hop FROM part UNION SELECT w.start, e.b, hop + 1 FROM w JOIN e ON e.a = w.id WHERE hop < 4),
      m AS (SELECT start, id, min(hop) AS hop FROM w GROUP BY ALL), c AS (SELECT m.*, row_number() OVER (PARTITION BY start ORDER BY hop, id) AS k FROM m JOIN part ON p_partkey = id WHERE hop > 0 AND p_size = 7)
      SELECT start AS id, id AS nearest, hop::INTEGER AS hop FROM c WHERE k = 1"""),
    "g03_contraction": (g03, None),
    "g04_line_classes": (g04_classes, None),
    "g04_networks": (g04, RL + """, j AS (SELECT p_partkey AS id FROM part WHERE p_size % 3 = 0),
      m AS (SELECT a, b, a IN (SELECT id FROM j) AS ja, b IN (SELECT id FROM j) AS jb FROM links),
      e AS (SELECT a, b FROM m WHERE ja AND jb UNION SELECT b, a FROM m WHERE ja AND jb),
      w AS (SELECT id, id AS root FROM j UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id),
      g AS (SELECT id, min(root) AS root FROM w GROUP BY id)
      SELECT root::VARCHAR AS network, 'junction' AS kind, id FROM g
      UNION ALL SELECT DISTINCT g.root::VARCHAR, 'item', h.item FROM g JOIN (SELECT a AS j, b AS item FROM m WHERE ja AND NOT jb UNION ALL SELECT b, a FROM m WHERE jb AND NOT ja) h ON h.j = g.id
      UNION ALL SELECT a || '-' || b, 'item', unnest([a, b]) FROM m WHERE NOT ja AND NOT jb"""),
    "g05_directions": (g05, """WITH e AS (SELECT l_orderkey AS stream, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS tier, CASE WHEN l_quantity > 15 THEN 1 ELSE -1 END AS sign FROM lineitem),
      p AS (SELECT stream, tier, min(sign) AS lo, max(sign) AS hi FROM e GROUP BY ALL) SELECT stream, tier, CASE WHEN lo <> hi THEN 'conflict' WHEN lo > 0 THEN 'forward' ELSE 'reverse' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY tier) AS k FROM p) WHERE k = 1"""),
    "g05_valve_propagation": (g05_valves, """WITH e AS (SELECT l_orderkey AS stream, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS tier, CASE WHEN l_quantity > 15 THEN 1 ELSE -1 END AS sign FROM lineitem),
      p AS (SELECT stream, tier, min(sign) AS lo, max(sign) AS hi FROM e GROUP BY ALL), d AS (SELECT stream, CASE WHEN lo <> hi THEN 'conflict' WHEN lo > 0 THEN 'forward' ELSE 'reverse' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY tier) AS k FROM p) WHERE k = 1 AND stream % 3 = 0),
      v AS (SELECT min(l_orderkey) AS x, max(l_orderkey) AS y FROM lineitem GROUP BY l_partkey, l_suppkey HAVING min(l_orderkey) <> max(l_orderkey)),
      q AS (SELECT x AS stream, y AS other FROM v UNION ALL SELECT y, x FROM v)
      SELECT q.stream, CASE WHEN count(DISTINCT direction) > 1 THEN 'conflict' ELSE min(direction) END AS direction FROM q JOIN d ON d.stream = q.other WHERE direction <> 'conflict' AND q.stream NOT IN (SELECT stream FROM d) GROUP BY q.stream"""),
    "g06_shortest_paths": (g06, None),
    "g07_sheet_edges": (g07, "WITH " + LINKS + """, c AS (SELECT a // 40 AS s, b // 40 AS o, CASE WHEN (a + b) % 5 = 0 THEN 'in' ELSE 'out' END AS d FROM links),
      n AS (SELECT least(s, o) AS a, greatest(s, o) AS b, CASE WHEN s < o THEN d WHEN d = 'out' THEN 'in' ELSE 'out' END AS d FROM c WHERE s <> o) SELECT a, b, count(*) AS connectors, CASE WHEN count(DISTINCT d) > 1 THEN 'conflict' ELSE min(d) END AS direction FROM n GROUP BY a, b"""),
    "g08_hierarchy": (g08, """SELECT r_name AS path, 1 AS depth FROM region UNION ALL SELECT r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "g09_closure": (g09, """WITH RECURSIVE e AS (SELECT p.p_partkey AS a, q.p_partkey AS b FROM part p JOIN part q ON q.p_partkey = 2 * p.p_partkey WHERE p.p_partkey > 0), w AS (SELECT a AS start, b AS id FROM e WHERE a % 2 = 1 UNION SELECT w.start, e.b FROM w JOIN e ON e.a = w.id) SELECT start, id FROM w"""),
    "w13_latest_decision": (w13, """SELECT o_custkey, o_orderkey AS decision_id, previous, o_orderstatus FROM (SELECT *, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE nxt IS NULL"""),
    "l01_apply_review": (l01, """WITH s AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'erase' WHEN o_orderkey % 2 = 0 THEN 'correct' ELSE 'confirm' END AS action, CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN 'BUILDING' ELSE 'OTHER' END AS value FROM orders)
      SELECT CASE WHEN c_custkey IS NULL THEN 'refused: unknown id' WHEN action = 'erase' THEN 'refused: unknown action' WHEN action = 'correct' AND trim(value) = '' THEN 'refused: no value' WHEN action = 'correct' AND value = c_mktsegment THEN 'no change' ELSE action END AS outcome, count(*) AS n
      FROM s LEFT JOIN customer ON c_custkey = id GROUP BY 1"""),
    "l02_renamed_texts": (l02_applied, None),
    "l02_tag_references": (l02, """WITH p AS (SELECT floor(p_partkey / 40)::BIGINT AS model, 'TI-' || (p_partkey % 37) AS tag, row_number() OVER (PARTITION BY floor(p_partkey / 40) ORDER BY p_partkey) - 1 AS i, p_partkey FROM part),
      n AS (SELECT model, lower(tag) AS name, 'i' AS kind FROM p UNION ALL SELECT model, 'c-' || p_partkey, 'c' FROM p),
      a AS (SELECT DISTINCT model, o.old, o.new FROM p, (VALUES ('TI-5', 'TI-500'), ('TI-1', 'TI-100'), ('TI-7', 'TI-8'), ('TI-9', 'C-1')) o(old, new)),
      r AS (SELECT a.*, (SELECT count(*) FROM n WHERE n.model = a.model AND n.name = lower(a.old)) AS own, (SELECT count(*) FROM n WHERE n.model = a.model AND n.name = lower(a.new)) AS there FROM a),
      w AS (SELECT *, CASE WHEN own = 0 THEN 'no such tag' WHEN own > 1 THEN 'ambiguous name' WHEN there > 0 THEN 'held by another item' END AS why FROM r)
      SELECT model, why AS place, old, new FROM w WHERE why IS NOT NULL
      UNION ALL SELECT p.model, unnest(['instruments[' || i || '].tag', 'controllers[' || i || '].measurement']), w.old, w.new FROM w JOIN p ON p.model = w.model AND p.tag = w.old WHERE why IS NULL"""),
    "l03_verdicts": (l03, """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'rejected' WHEN o_orderkey % 4 = 3 THEN 'unverified' WHEN o_orderkey % 3 = 0 THEN 'verified' WHEN o_orderkey % 3 = 1 THEN 'disputed' ELSE 'source_checked' END AS status, count(*) AS n FROM orders GROUP BY 1"""),
    "l04_evidence_register": (l04, """WITH p AS (SELECT conv_id, count(DISTINCT length(text) % 2) FILTER (turn % 3 <> 2) AS v, count(*) FILTER (turn % 3 <> 2) AS accepted, count(*) FILTER (turn % 3 = 2) AS needs, count(*) AS n FROM conversations GROUP BY conv_id)
      SELECT conv_id, CASE WHEN v > 1 THEN 'disputed' WHEN needs > 0 THEN 'needs_data' WHEN accepted = n THEN 'answered' WHEN accepted > 0 THEN 'partial' ELSE 'unanswered' END AS state, accepted, n FROM p"""),
    "f02_dates": (f02, """SELECT event_id, strftime(ts, '%H:%M') AS hhmm, TIMESTAMP '1899-12-30' + INTERVAL 1 DAY * ((event_id % 1000 + 45000)::INTEGER) + INTERVAL 6 HOUR AS serial_ts, date_trunc('minute', ts) AS minute_ts FROM events"""),
    "f03_digest": (f03, """SELECT c_custkey, substr(sha256('{"c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}'), 1, 16) AS digest FROM customer"""),
    "f04_similarity": (f04, """WITH w AS (SELECT p_partkey AS id, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM part)
      SELECT a.id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM w a JOIN w b ON b.id + 1 = a.id"""),
    "f05_significant": (f05, "SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0 ELSE round_even(o_totalprice * pow(10, 2 - floor(log10(abs(o_totalprice)))), 0) / pow(10, 2 - floor(log10(abs(o_totalprice)))) END AS sig FROM orders"),
    "f06_statements": (f06, """SELECT 'order priority ' || o_orderpriority || ' has status ' || o_orderstatus AS text, count(*) AS targets, min(o_orderkey) AS first, substr(sha256('order priority ' || o_orderpriority || ' has status ' || o_orderstatus), 1, 12) AS id FROM orders GROUP BY ALL"""),
    "o01_review_queue": (o01, I_ + """SELECT sheet, id, tier, row_number() OVER (PARTITION BY sheet ORDER BY CASE tier WHEN 'red' THEN 0 WHEN 'amber' THEN 1 ELSE 2 END, size / 50 DESC, coalesce(CASE WHEN id % 7 <> 0 THEN price END, -1), id) AS place
      FROM (SELECT *, CASE WHEN size > 40 THEN 'red' WHEN size > 20 THEN 'amber' ELSE 'green' END AS tier FROM items)"""),
    "o02_top_per_group": (o02, """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?]*)', 1) AS section, length(html) % 97 AS score FROM pages),
      o AS (SELECT *, row_number() OVER (PARTITION BY section, host ORDER BY score DESC, page_id) AS k FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, page_id) AS place FROM o WHERE k = 1)
      SELECT section, host, page_id, score, place FROM t WHERE place <= 8"""),
    "o03_paged_search": (o03, """WITH h AS (SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring')) SELECT *, (SELECT count(*) FROM h) AS total FROM h ORDER BY p_partkey LIMIT 20 OFFSET 40"""),
    "o05_first_divergence": (o05_divergence, "SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag <> l_linestatus) AS first_line FROM lineitem GROUP BY l_orderkey"),
    "a20_provenance": (a20, """WITH l AS (SELECT p_type, 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_type, 'size', p_size::VARCHAR FROM part) SELECT p_type, field, count(*) AS n, count(DISTINCT value) AS "values" FROM l GROUP BY ROLLUP (p_type, field)"""),
    "a21_costs": (a21, """SELECT o_orderpriority, o_orderstatus, count(*) AS records, count(*) FILTER (o_orderstatus = 'P') AS failures, round(sum(o_totalprice), 2) AS cost, max(o_totalprice) AS largest FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))"""),
    "a22_effort": (a22, """SELECT c_mktsegment, count(o_orderkey) AS observed, count(*) FILTER (o_orderkey IS NULL) AS missing, round(sum(o_totalprice), 2) AS total, median(o_totalprice) AS median FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON c_custkey = o_custkey GROUP BY 1"""),
    "a29_setpoints": (a29, """SELECT user_id, event_type, off FROM (SELECT user_id, event_type, abs(avg(value) - arg_max(value, event_id)) / greatest(abs(arg_max(value, event_id)), 1e-9) AS off FROM events GROUP BY ALL) WHERE off > 0.5"""),
    "a30_balance": (a30, """SELECT l_partkey, abs(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE -l_quantity END)) / greatest(abs(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)), 1e-9) AS imbalance FROM lineitem GROUP BY 1"""),
    "a31_status_matrix": (a31, """SELECT o_custkey % 40 AS family, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS P, count(DISTINCT o_orderpriority) AS sources FROM orders GROUP BY 1"""),
    "a32_requests": (a32_requests, """WITH r AS (SELECT DISTINCT s_nationkey AS site, l_returnflag || l_linenumber AS question, l_orderkey AS finding, l_linestatus AS item, l_partkey % 3 AS place FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_discount > 0.09),
      n AS (SELECT site, question, item, count(DISTINCT finding) AS of FROM r GROUP BY ALL), p AS (SELECT site, question, item, place, count(DISTINCT finding) AS has FROM r GROUP BY ALL),
      q AS (SELECT p.*, has = of AS shared FROM p JOIN n USING (site, question, item))
      SELECT question, item, site, place, NULL::BIGINT AS finding FROM q WHERE shared UNION ALL SELECT r.question, r.item, r.site, r.place, r.finding FROM r JOIN q USING (site, question, item, place) WHERE NOT shared"""),
    "a32_site_rollup": (a32, """WITH l AS (SELECT s_nationkey AS site, l_returnflag || l_linenumber AS question, l_orderkey AS finding, l_discount > 0.09 AS fires FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey % 7 <> 0 OR l_returnflag || l_linenumber <> 'R3'),
      p AS (SELECT site, question, bool_or(fires) AS fires, count(DISTINCT finding) FILTER (fires) AS n FROM l GROUP BY ALL), s AS (SELECT DISTINCT site FROM l), q AS (SELECT DISTINCT question FROM l),
      g AS (SELECT q.question, s.site, p.site IS NOT NULL AS ran, coalesce(fires, false) AS fires, coalesce(n, 0) AS n FROM q CROSS JOIN s LEFT JOIN p ON p.site = s.site AND p.question = q.question),
      c AS (SELECT question, count(*) FILTER (fires) AS fired, sum(n)::BIGINT AS findings, coalesce(string_agg(site, ' ' ORDER BY site) FILTER (fires), '') AS fired_at, coalesce(string_agg(site, ' ' ORDER BY site) FILTER (ran AND NOT fires AND site % 3 <> 0), '') AS quiet_at,
        coalesce(string_agg(site, ' ' ORDER BY site) FILTER (ran AND NOT fires AND site % 3 = 0), '') AS not_checked_at, coalesce(string_agg(site, ' ' ORDER BY site) FILTER (NOT ran), '') AS not_run_at FROM g GROUP BY question)
      SELECT *, row_number() OVER (ORDER BY fired DESC, findings DESC, question)::INTEGER AS place FROM c"""),
    "a33_headline": (a33, "SELECT count(*) AS checks, count(*) FILTER (l_discount <= 0.05) AS passed, count(*) FILTER (l_tax IS NULL) AS not_checked FROM lineitem"),
    "a34_staging_check": (a34, """WITH p AS (SELECT p_partkey % 60 AS parent, p_name, p_type FROM part), f AS (SELECT 'duplicate' AS finding, parent, count(*) AS n FROM p GROUP BY parent, p_name, p_type HAVING count(*) > 1
      UNION ALL SELECT 'orphan', parent, count(*) FROM p WHERE parent NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 55) GROUP BY parent) SELECT finding, parent, sum(n)::BIGINT AS n FROM f GROUP BY ALL"""),
    "a35_impact_ranges": (a35, """WITH e AS (SELECT o_orderstatus, l_quantity * 0.9 AS a, l_quantity * 1.1 AS b, 1000 * (0.05 - l_discount) AS c, 2000 * (0.05 - l_discount) AS d, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      k AS (SELECT *, c > d OR l_linenumber = 7 AS bad, least(a * c, a * d, b * c, b * d) AS lo, greatest(a * c, a * d, b * c, b * d) AS hi FROM e),
      m AS (SELECT o_orderstatus, 'kwh' AS measure, bad, lo, hi FROM k UNION ALL SELECT o_orderstatus, 'cost_electricity', bad, least(lo * 0.1, lo * 0.12), greatest(hi * 0.1, hi * 0.12) FROM k)
      SELECT o_orderstatus, measure, count(*) FILTER (NOT bad) AS changes, count(*) FILTER (bad) AS refused, round(sum(lo) FILTER (NOT bad), 1) AS lo, round(sum(hi) FILTER (NOT bad), 1) AS hi FROM m GROUP BY 1, 2"""),
    "a36_duplicate_tags": (a36, I_ + "SELECT kind, count(*) AS items, count(DISTINCT tag) AS tags FROM (SELECT *, count(*) OVER (PARTITION BY upper(tag)) AS n FROM items) WHERE n > 1 GROUP BY kind"),
    "k01_graph_bundle": (k01_bundle, """WITH nd AS (SELECT 'N' || n_nationkey AS id, 'nation' AS type FROM nation UNION ALL SELECT 'S' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'P' || p_partkey, 'part' FROM part WHERE p_size > 1),
      e AS (SELECT 1 AS section, s_suppkey AS item, 'part_of' AS type, 'S' || s_suppkey AS a, 'N' || s_nationkey AS b FROM supplier UNION ALL SELECT 2, n_nationkey, 'within', 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 3, p_partkey, 'follows', 'P' || p_partkey, 'P' || (p_partkey + 1) FROM part),
      f AS (SELECT CASE WHEN item % 5 = 0 THEN 'own-' || section || '-' || item ELSE printf('E%05d', row_number() OVER (ORDER BY section, item)) END AS id, type, a IN (SELECT id FROM nd) AND b IN (SELECT id FROM nd) AS ok FROM e),
      ev AS (SELECT 'S' || (o_custkey % 20) AS item, o_orderstatus AS decision FROM orders)
      SELECT 'nodes' AS record, type, count(*) AS n, min(id) AS first FROM nd GROUP BY type
      UNION ALL SELECT 'edges', type, count(*), min(id) FROM f WHERE ok GROUP BY type
      UNION ALL SELECT 'claims', 'size', count(*), min('P' || p_partkey) FROM part WHERE p_size > 1
      UNION ALL SELECT 'events', decision, count(*), min(item) FROM ev WHERE item IN (SELECT id FROM nd) GROUP BY decision
      UNION ALL SELECT 'not_exported node', 'the id repeats', count(*), min('S' || s_suppkey) FROM supplier WHERE s_suppkey % 10 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'not_exported edge', 'an end is not in the graph', count(*), min(id) FROM f WHERE NOT ok HAVING count(*) > 0
      UNION ALL SELECT 'not_exported claim', 'its item is not in the graph', count(*), min('P' || p_partkey) FROM part WHERE NOT p_size > 1 HAVING count(*) > 0
      UNION ALL SELECT 'not_exported event', 'its item is not in the graph', count(*), min(item) FROM ev WHERE item NOT IN (SELECT id FROM nd) HAVING count(*) > 0"""),
    "k01_graph_edges": (k01, """WITH e AS (SELECT 1 AS section, s_suppkey AS item, 'part_of' AS type, 'S' || s_suppkey AS "from", 'N' || s_nationkey AS "to" FROM supplier UNION ALL SELECT 2, n_nationkey, 'within', 'N' || n_nationkey, 'R' || n_regionkey FROM nation)
      SELECT 'E' || section || '-' || lpad((row_number() OVER (PARTITION BY section ORDER BY item))::VARCHAR, 6, '0') AS id, type, "from", "to" FROM e"""),
    "k02_review_rows": (k02, I_ + """SELECT id, CASE WHEN id % 5 = 0 THEN '''=' || tag ELSE tag END AS cell, concat_ws('; ', CASE WHEN size > 40 THEN 'large' END, CASE WHEN price < 950 THEN 'cheap' END, CASE WHEN tag LIKE 'PSV%' THEN 'relief' END) AS why FROM items"""),
    "k03_staging_rows": (k03, I_ + """SELECT DISTINCT 0 AS level, '' AS parent, kind AS name FROM items UNION ALL SELECT 1, kind, tag || '#' || id FROM items UNION ALL SELECT 2, tag || '#' || id, 'size' FROM items"""),
    "k04_tag_tree": (k04, I_ + """SELECT unit, sheet, '["' || string_agg(tag, '","' ORDER BY tag) || '"]' AS tags FROM items GROUP BY unit, sheet"""),
    "s18_content_hashes": (s18, "SELECT page_id, sha256(replace(html, chr(13) || chr(10), chr(10))) AS hash, octet_length(encode(html)) AS bytes FROM pages"),
}
