"""Queries that match and score boxes, and statistics over replicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import audits as A
from millrace.operators import checks as C
from millrace.operators import matching as M
from millrace.operators import scoring as S
from millrace.operators import tiles
from millrace.operators.identity import contained
from millrace.plans.standins import BOXES, keys, preds, table
from millrace.scratch import written

WITH = "WITH " + BOXES


def f01(spark: SparkSession, d: str) -> DataFrame:
    pairs = M.near_pairs(preds(spark, d), keys(spark, d), ["sheet"], within=30.0)
    return pairs.select(F.col("a_tool").alias("tool"), "sheet", F.col("a_id").alias("pred_id"), F.col("b_id").alias("key_id"), M.iou("a_", "b_").alias("iou"), M.gap("a_", "b_").alias("gap"), M.containment("a_", "b_").alias("contain"))


def _matches(spark: SparkSession, d: str, need_class: bool = False) -> DataFrame:
    return M.match(preds(spark, d), keys(spark, d), ["sheet"], ["tool"], need_class=need_class, threshold=0.1)


def j01(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by identity: a prediction hits its own key where they overlap by half and agree on class."""
    p, k = preds(spark, d), keys(spark, d)
    met = M.near_pairs(p, k, ["sheet"]).where("a_id = b_id and a_class = b_class").where(M.iou("a_", "b_") >= 0.5)
    hits = met.select(F.col("a_tool").alias("tool"), "sheet", F.col("a_id").alias("id"))
    return S.counts(hits, p, k, ["tool"], "sheet")


COUNTS = WITH + """, hits AS (SELECT tool, sheet, count(*) AS tp FROM scored WHERE pred_id = key_id AND pred_class = key_class AND iou >= 0.5 GROUP BY tool, sheet),
nk AS (SELECT sheet, count(*) AS in_key FROM keys GROUP BY sheet), np AS (SELECT tool, sheet, count(*) AS predicted FROM preds GROUP BY tool, sheet),
counts AS (SELECT t.tool, nk.sheet, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted, in_key
  FROM nk, (VALUES (0), (1)) AS t(tool) LEFT JOIN hits ON hits.tool = t.tool AND hits.sheet = nk.sheet LEFT JOIN np ON np.tool = t.tool AND np.sheet = nk.sheet),
prf AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN in_key > 0 THEN tp / in_key ELSE 0 END AS recall,
  CASE WHEN predicted + in_key > 0 THEN 2.0 * tp / (predicted + in_key) ELSE 0 END::DOUBLE AS f1 FROM counts)
"""


def a01(spark: SparkSession, d: str) -> DataFrame:
    return S.prf(_counts(spark, d))


def a02(spark: SparkSession, d: str) -> DataFrame:
    return S.review_load(_counts(spark, d))


def a03(spark: SparkSession, d: str) -> DataFrame:
    return S.rollup(_counts(spark, d), ["tool"])


def a04(spark: SparkSession, d: str) -> DataFrame:
    return S.prf(_counts(spark, d)).withColumn("t", F.concat(F.lit("tool_"), "tool")).groupBy("sheet").pivot("t", ["tool_0", "tool_1"]).agg(F.first("f1"))


def a05(spark: SparkSession, d: str) -> DataFrame:
    """Class outcomes per tool and over all: correct, wrong, missed; accuracy on found and end-to-end recall."""
    k = keys(spark, d).select("id", "sheet", F.col("class").alias("want"))
    p = preds(spark, d).select("tool", "id", F.col("class").alias("got"))
    tools = p.select("tool").distinct()
    joined = k.crossJoin(F.broadcast(tools)).join(p, ["tool", "id"], "left")
    return joined.rollup("tool").agg(
        F.count_if(F.col("got") == F.col("want")).alias("correct"),
        F.count_if(F.col("got") != F.col("want")).alias("wrong"),
        F.count_if(F.col("got").isNull()).alias("missed"),
        (F.count_if(F.col("got") == F.col("want")) / F.count("got")).alias("accuracy_on_found"),
        (F.count_if(F.col("got") == F.col("want")) / F.count("*")).alias("recall"),
    )


def a08(spark: SparkSession, d: str) -> DataFrame:
    atom = lambda df: df.select(F.col("class").alias("section"), F.col("id").cast("string").alias("item"), F.col("sheet").cast("string").alias("value"))
    one = lambda t: S.atom_scores(atom(keys(spark, d)), atom(preds(spark, d).where(F.col("tool") == t))).withColumn("tool", F.lit(t))
    return one(0).unionByName(one(1))


def a09(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts: replicates are compared only on the same sheets; a cohort is named by the digest of its description."""
    own = S.prf(_counts(spark, d)).withColumn("family", (F.col("sheet") % 3).cast("string"))
    named = own.withColumn("cohort", F.substring(F.sha2(F.concat_ws("|", "family", F.lit("test")).cast("binary"), 256), 1, 12))
    return named.groupBy("cohort", "family", "tool").agg(F.count("*").alias("sheets"), F.sum("tp").alias("tp"), F.count_if(F.col("predicted") == 0).alias("failures"), F.avg("f1").alias("mean_f1"))


def a10(spark: SparkSession, d: str) -> DataFrame:
    """Known-answer controls derived from the key: perfect, wrong class, shifted and empty predictions."""
    k = keys(spark, d)
    shift = {c: F.col(c) + 500 for c in M.BOX}
    made = [k.withColumn("control", F.lit("perfect")), k.withColumn("control", F.lit("wrong_class")).withColumn("class", F.lit("none")), k.withColumns(shift).withColumn("control", F.lit("shifted"))]
    given = made[0].unionByName(made[1]).unionByName(made[2])
    met = M.near_pairs(given, k, ["sheet"]).where("a_id = b_id and a_class = b_class").where(M.iou("a_", "b_") >= 0.5)
    hits = met.groupBy(F.col("a_control").alias("control")).agg(F.count("*").alias("tp"))
    names = spark.createDataFrame([("perfect",), ("wrong_class",), ("shifted",), ("empty",)], "control string")
    predicted = given.groupBy("control").agg(F.count("*").alias("predicted"))
    total = k.agg(F.count("*").alias("in_key"))
    out = names.join(hits, "control", "left").join(predicted, "control", "left").crossJoin(total)
    return S.prf(out.select("control", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("predicted", F.lit(0)).alias("predicted"), "in_key"))


def a11(spark: SparkSession, d: str) -> DataFrame:
    """Judged claims: labels of documents against a rule on their length; missing judgements count."""
    truth = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("want"))
    rule = table(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("got"))
    j = truth.join(rule, "doc_id", "left")
    return j.groupBy("want").agg(F.count("*").alias("expected"), F.count_if(F.col("got") == F.col("want")).alias("hits"), F.count_if(F.col("got").isNull()).alias("missing"), (F.count_if(F.col("got") == F.col("want")) / F.count("*")).alias("accuracy"))


def a12(spark: SparkSession, d: str) -> DataFrame:
    own = S.prf(_counts(spark, d)).withColumn("block", F.floor(F.col("sheet") / 10).cast("long"))
    return S.run_interval(own, ["tool", "block"], "f1")


T_SQL = "CASE WHEN {0} > 30 THEN 1.96 WHEN {0} >= 30 THEN 2.042 WHEN {0} >= 20 THEN 2.086 WHEN {0} >= 15 THEN 2.131 WHEN {0} >= 10 THEN 2.228 WHEN {0} >= 9 THEN 2.262 WHEN {0} >= 8 THEN 2.306 WHEN {0} >= 7 THEN 2.365 WHEN {0} >= 6 THEN 2.447 WHEN {0} >= 5 THEN 2.571 WHEN {0} >= 4 THEN 2.776 WHEN {0} >= 3 THEN 3.182 WHEN {0} >= 2 THEN 4.303 WHEN {0} >= 1 THEN 12.706 END"


def a13(spark: SparkSession, d: str) -> DataFrame:
    own = S.prf(_counts(spark, d)).withColumn("block", F.floor(F.col("sheet") / 10).cast("long"))
    return S.welch(own, ["block"], "tool", 0, 1, "f1")


def a14(spark: SparkSession, d: str) -> DataFrame:
    return S.bootstrap(written(_counts(spark, d), "counts"), "f1", 500, "b1")


def a15(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("mismatch"))
    lo, hi = S.wilson(F.col("mismatch").cast("double"), F.col("n").cast("double"))
    return own.select("l_returnflag", "l_linestatus", "n", "mismatch", lo.alias("lo"), hi.alias("hi"))


def a15_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Population-weighted rate per layer over strata of which one row in ten was checked."""
    own = table(spark, d, "lineitem").withColumn("checked", (F.col("l_orderkey") % 10) == 0)
    strata = own.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("population"), F.count_if("checked").alias("n"), F.count_if(F.col("checked") & (F.col("l_discount") > 0.05)).alias("bad"))
    used = strata.where("n > 0")
    return used.groupBy("l_returnflag").agg(F.sum("n").alias("checked"), (F.sum(F.col("population") * F.col("bad") / F.col("n")) / F.sum("population")).alias("rate"))


def a16(spark: SparkSession, d: str) -> DataFrame:
    """Two readers of the same items: agreement of each with the hidden label, and its Wilson lower bound."""
    own = table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 2).alias("reader"), (F.col("o_orderkey") % 5 == 0).alias("wrong"), (F.col("o_orderkey") % 9 == 0).alias("unclear"))
    per = own.groupBy("source", "reader").agg(F.count_if(~F.col("wrong") & ~F.col("unclear")).alias("agree"), F.count_if(F.col("wrong") & ~F.col("unclear")).alias("disagree"), F.count_if("unclear").alias("unclear"))
    n = (F.col("agree") + F.col("disagree")).cast("double")
    return per.withColumn("confidence", S.wilson(F.col("agree").cast("double"), n)[0])


def _rated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("run"), F.round("l_discount", 2).alias("risk"), (F.col("l_quantity") > 25 + F.col("l_linenumber") * 4).cast("int").alias("wrong"))


def a17(spark: SparkSession, d: str) -> DataFrame:
    return S.caught(_rated(spark, d), 0.2, ["run"])


def a18(spark: SparkSession, d: str) -> DataFrame:
    return S.green_cut(_rated(spark, d), ["run"], 0.24)


def a19(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a non-negative logistic fit; a row a feature."""
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"), (F.col("l_extendedprice") > 40000).cast("int").alias("label"))
    weights = S.logistic_nonnegative(rows, ["quantity", "discount", "tax"], "label")
    return spark.createDataFrame([(k, round(v, 2)) for k, v in weights.items()], "feature string, weight double")


def p19(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), (F.col("l_tax") * 10).alias("tax"))
    rated = S.risk_tiers(rows, {"quantity": 1.5, "discount": 1.0, "tax": 0.75, "intercept": -2.0}, 0.3, 0.5)
    return rated.groupBy("tier", "why").agg(F.count("*").alias("n"))


def o04(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return S.stratified_sample(own, "c_mktsegment", "c_custkey", 60, "s1").select("c_custkey", "c_mktsegment", "weight")


def w09(spark: SparkSession, d: str) -> DataFrame:
    return M.confidence_rank(preds(spark, d), ["tool", "sheet"]).select("tool", "sheet", "id", "conf_rank")


def j20(spark: SparkSession, d: str) -> DataFrame:
    return M.agreement(preds(spark, d))


def j10(spark: SparkSession, d: str) -> DataFrame:
    own = keys(spark, d)
    return M.nearest_box(own.where("class = 'instrument'"), own.where("class in ('pump', 'tank')"), ["sheet"], 120.0)


def j26(spark: SparkSession, d: str) -> DataFrame:
    return M.item_roles(keys(spark, d), ["sheet"], 60.0)


def j23(spark: SparkSession, d: str) -> DataFrame:
    point = lambda b: b.select("tool", "sheet", "id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    truth = keys(spark, d).withColumn("tool", F.explode(F.array(F.lit(0), F.lit(1))))
    return M.match_points(point(preds(spark, d)), point(truth), ["tool", "sheet"], 40.0)


def j21(spark: SparkSession, d: str) -> DataFrame:
    """Class outcome of each key symbol per tool: correct, wrong, missed."""
    k = keys(spark, d).select("sheet", "id", F.col("class").alias("want"))
    p = preds(spark, d).select("tool", "id", F.col("class").alias("got"))
    joined = k.crossJoin(F.broadcast(p.select("tool").distinct())).join(p, ["tool", "id"], "left")
    outcome = F.when(F.col("got").isNull(), "missed").when(F.col("got") == F.col("want"), "correct").otherwise("wrong")
    return joined.groupBy("tool", "sheet", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def j10_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents of instruments by links of their sheet's neighbours, through chains, or by position."""
    k = keys(spark, d)
    own = k.select("id", "sheet", F.when(F.col("class") == "instrument", "instrument").otherwise("equipment").alias("role"), *M.BOX)
    near = own.where("id % 3 <> 0").select(F.col("id").alias("a"), (F.col("id") + 1 + F.col("id") % 2).alias("b"), "sheet")
    links = near.join(own.select(F.col("id").alias("b"), F.col("sheet").alias("s")), "b").where("sheet = s").select("a", "b")
    return A.parents(own, links)


def j22(spark: SparkSession, d: str) -> DataFrame:
    """Listed identifiers contained in any name of the same group, and whether one of its class has it."""
    own = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 40).cast("long").alias("g"), "p_name", (F.col("p_size") % 3).cast("string").alias("class"))
    listed = own.select("g", F.element_at(F.split("p_name", " "), 2).alias("identifier"), "class").distinct()
    return contained(listed, own.select("g", F.col("p_name").alias("tag"), "class"), ["g"])


def j28(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping tiles of each sheet merged into symbols, with links of neighbouring boxes, and the counts of each sheet."""
    own = preds(spark, d)
    tag = F.when(F.col("id") % 3 != 0, F.concat(F.lit("T-"), F.col("id") % 50))
    edges = F.when((F.col("id") + F.col("tool")) % 4 == 0, F.array(F.when(F.col("tool") == 0, "right").otherwise("left"))).otherwise(F.array().cast("array<string>"))
    boxes = own.select("sheet", (F.col("id") * 2 + F.col("tool")).alias("id"), F.col("tool").alias("tile"), "class", tag.alias("tag"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *M.BOX, edges.alias("edges"))
    shown = boxes.select("sheet", F.col("id").alias("a"), (F.col("id") + 2).alias("b"))
    symbols, links_, stats = tiles.merge_tiles(boxes, shown)
    rows = [
        symbols.select("sheet", F.lit("symbol").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.concat_ws(" ", "class", "tag", F.col("confidence").cast("string"), F.array_join("parts", "+")).alias("detail")),
        links_.select("sheet", F.lit("link").alias("kind"), "a", "b", F.lit("").alias("detail")),
        stats.select("sheet", F.lit("counts").alias("kind"), F.col("symbols").alias("a"), F.col("links").alias("b"), F.concat_ws(" ", "tile_symbols", "merged_groups", "seam_unions", "cross_class_merges", "tile_links", "links_dropped", "stitch_symbols").alias("detail")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def j29(spark: SparkSession, d: str) -> DataFrame:
    from millrace.plans.standins import links

    pairs = written(M.match(preds(spark, d), keys(spark, d), ["sheet"], ["tool"], need_class=True, threshold=0.3), "pairs")
    views = [M.transferred_links(pairs.where(F.col("tool") == t).select("pred_id", "key_id"), links(spark, d)).withColumn("tool", F.lit(t)) for t in (0, 1)]
    return views[0].unionByName(views[1])


def u01(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that one method has and the other has not, and whether they are right."""
    own = table(spark, d, "lineitem")
    pair = lambda c: own.where(c).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return C.pair_changes(pair("l_quantity < 30"), pair("l_quantity > 20"), pair("l_discount > 0.03")).groupBy("change", "right").agg(F.count("*").alias("n"))


def u02(spark: SparkSession, d: str) -> DataFrame:
    """Regenerate and compare: result rows that differ from the recorded ones, both ways."""
    made = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    recorded = made.where("o_orderpriority <> '5-LOW'").withColumn("n", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("n") + 1).otherwise(F.col("n")))
    return C.regenerated(made, recorded, "o_orderpriority")


def u03(spark: SparkSession, d: str) -> DataFrame:
    """Identities missing on either side."""
    p, li = table(spark, d, "part").select(F.col("p_partkey").alias("id")), table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return C.identity_sets(p, li)


def a06(spark: SparkSession, d: str) -> DataFrame:
    """Parent assignment by position against the truth, overall, by class of the parent, and by agreement (grouping sets)."""
    near = j10(spark, d).select("sheet", "id", "nearest", "gap")
    truth = keys(spark, d).select(F.col("id").alias("nearest"), F.col("class").alias("method"))
    own = near.join(truth, "nearest").withColumn("right", (F.col("nearest") + F.col("id")) % 4 != 0).withColumn("close", F.col("gap") < 40)
    own.createOrReplaceTempView("millrace_parents")
    return spark.sql("SELECT method, close, count(*) AS n, count_if(right) AS correct FROM millrace_parents GROUP BY GROUPING SETS ((), (method), (close))")


WILSON = "(({k} / {n} + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n}) {s} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n})) / (1 + 1.96 * 1.96 / {n}))"
GAPS = "sqrt(pow(greatest(0.0, b.x0 - a.x1, a.x0 - b.x1), 2) + pow(greatest(0.0, b.y0 - a.y1, a.y0 - b.y1), 2))"

QUERIES = {
    "f01_box_geometry": (f01, WITH + f"""SELECT a.tool, a.sheet, a.id AS pred_id, b.id AS key_id, s.iou, {GAPS} AS gap, inter / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS contain
      FROM preds a JOIN keys b ON a.sheet = b.sheet JOIN scored s ON s.tool = a.tool AND s.pred_id = a.id AND s.key_id = b.id WHERE {GAPS} <= 30"""),
    "j01_greedy_match": (j01, "WITH RECURSIVE " + BOXES + """, c AS (SELECT tool, sheet, pred_id, key_id, iou, row_number() OVER (PARTITION BY tool, sheet ORDER BY iou DESC, pred_id, key_id) AS k FROM scored WHERE iou >= 0.1),
      walk AS (SELECT tool, sheet, 0::BIGINT AS k, []::BIGINT[] AS up, []::BIGINT[] AS uk FROM (SELECT DISTINCT tool, sheet FROM c)
        UNION ALL SELECT w.tool, w.sheet, c.k, CASE WHEN list_contains(up, pred_id) OR list_contains(uk, key_id) THEN up ELSE list_append(up, pred_id) END, CASE WHEN list_contains(up, pred_id) OR list_contains(uk, key_id) THEN uk ELSE list_append(uk, key_id) END
        FROM walk w JOIN c ON c.tool = w.tool AND c.sheet = w.sheet AND c.k = w.k + 1),
      ends AS (SELECT tool, sheet, up, uk FROM (SELECT *, row_number() OVER (PARTITION BY tool, sheet ORDER BY k DESC) AS r FROM walk) WHERE r = 1),
      got AS (SELECT tool, sheet, unnest(up) AS pred_id, unnest(uk) AS key_id FROM ends)
      SELECT g.tool, g.sheet, g.pred_id, g.key_id, s.iou FROM got g JOIN scored s ON s.tool = g.tool AND s.pred_id = g.pred_id AND s.key_id = g.key_id AND s.sheet = g.sheet"""),
    "a01_precision_recall": (a01, COUNTS + "SELECT * FROM prf"),
    "a02_review_load": (a02, COUNTS + "SELECT *, predicted + in_key - 2 * tp AS corrections, CASE WHEN in_key > 0 THEN 100.0 * (predicted + in_key - 2 * tp) / in_key END::DOUBLE AS review_load FROM counts"),
    "a03_scorecard": (a03, COUNTS + """SELECT tool, tp, predicted, in_key, tp / predicted AS precision, tp / in_key AS recall, (2.0 * tp / (predicted + in_key))::DOUBLE AS f1
      FROM (SELECT tool, sum(tp)::BIGINT AS tp, sum(predicted)::BIGINT AS predicted, sum(in_key)::BIGINT AS in_key FROM counts GROUP BY tool)"""),
    "a04_sheet_pivot": (a04, COUNTS + "SELECT sheet, any_value(f1) FILTER (tool = 0) AS tool_0, any_value(f1) FILTER (tool = 1) AS tool_1 FROM prf GROUP BY sheet"),
    "a05_tag_summary": (a05, WITH + """SELECT t.tool, count(*) FILTER (p.class = k.class) AS correct, count(*) FILTER (p.class <> k.class) AS wrong, count(*) FILTER (p.class IS NULL) AS missed,
        count(*) FILTER (p.class = k.class) / count(p.class) AS accuracy_on_found, count(*) FILTER (p.class = k.class) / count(*) AS recall
      FROM keys k CROSS JOIN (VALUES (0), (1)) AS t(tool) LEFT JOIN preds p ON p.tool = t.tool AND p.id = k.id GROUP BY ROLLUP (t.tool)"""),
    "a06_parent_accuracy": (a06, WITH + f""", c AS (SELECT a.sheet, a.id, b.id AS nearest, b.class AS method, {GAPS} AS gap FROM keys a JOIN keys b ON a.sheet = b.sheet AND a.class = 'instrument' AND b.class IN ('pump', 'tank') WHERE {GAPS} <= 120),
      m AS (SELECT *, (nearest + id) % 4 <> 0 AS ok, gap < 40 AS close FROM (SELECT *, row_number() OVER (PARTITION BY sheet, id ORDER BY gap, nearest) AS k FROM c) WHERE k = 1)
      SELECT method, close, count(*) AS n, count(*) FILTER (ok) AS correct FROM m GROUP BY GROUPING SETS ((), (method), (close))"""),
    "a08_fact_atoms": (a08, WITH + """, k2 AS (SELECT keys.*, tool FROM keys, (VALUES (0), (1)) AS t(tool)),
      j AS (SELECT coalesce(k.tool, p.tool) AS tool, coalesce(k.class, p.class) AS section, k.id AS t, p.id AS g FROM k2 k FULL JOIN preds p ON p.id = k.id AND p.class = k.class AND p.tool = k.tool),
      a AS (SELECT tool, section, count(*) FILTER (t IS NOT NULL AND g IS NOT NULL) AS tp, count(g) AS predicted, count(t) AS in_key FROM j GROUP BY GROUPING SETS ((tool, section), (tool)))
      SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN in_key > 0 THEN tp / in_key ELSE 0 END AS recall, CASE WHEN predicted + in_key > 0 THEN 2.0 * tp / (predicted + in_key) ELSE 0 END::DOUBLE AS f1 FROM a"""),
    "a09_cohorts": (a09, COUNTS + "SELECT substr(sha256((sheet % 3)::VARCHAR || '|test'), 1, 12) AS cohort, (sheet % 3)::VARCHAR AS family, tool, count(*) AS sheets, sum(tp)::BIGINT AS tp, count(*) FILTER (predicted = 0) AS failures, avg(f1) AS mean_f1 FROM prf GROUP BY ALL"),
    "a10_known_answers": (a10, WITH + """, n AS (SELECT count(*) AS n FROM keys) SELECT c.control, c.tp, c.predicted, n AS in_key, c.tp / greatest(1, c.predicted) AS precision, c.tp / n AS recall, (2.0 * c.tp / (c.predicted + n))::DOUBLE AS f1
      FROM n, (SELECT 'perfect' AS control, n AS tp, n AS predicted FROM n UNION ALL SELECT 'wrong_class', 0, n FROM n UNION ALL SELECT 'shifted', 0, n FROM n UNION ALL SELECT 'empty', 0, 0) c"""),
    "a11_claim_judgement": (a11, """SELECT want, count(*) AS expected, count(*) FILTER (got = want) AS hits, count(*) FILTER (got IS NULL) AS missing, count(*) FILTER (got = want) / count(*) AS accuracy
      FROM (SELECT l.quality::VARCHAR AS want, r.got FROM labels l LEFT JOIN (SELECT doc_id, CASE WHEN n_chars > 500 THEN '1' ELSE '0' END AS got FROM documents WHERE doc_id % 7 <> 0) r USING (doc_id)) GROUP BY want"""),
    "a12_replicate_interval": (a12, COUNTS + f""", v AS (SELECT tool, sheet // 10 AS block, count(f1) AS n, avg(f1) AS mean, stddev_samp(f1) AS s FROM prf GROUP BY ALL)
      SELECT tool, block, n, mean, CASE WHEN n >= 2 THEN s END AS sd, CASE WHEN n >= 2 THEN mean - {T_SQL.format('(n - 1)')} * s / sqrt(n) END AS lo, CASE WHEN n >= 2 THEN mean + {T_SQL.format('(n - 1)')} * s / sqrt(n) END AS hi FROM v"""),
    "a13_welch": (a13, COUNTS + f""", v AS (SELECT sheet // 10 AS block, avg(f1) FILTER (tool = 0) - avg(f1) FILTER (tool = 1) AS diff, count(*) FILTER (tool = 0) AS na, count(*) FILTER (tool = 1) AS nb,
        var_samp(f1) FILTER (tool = 0) / count(*) FILTER (tool = 0) AS va, var_samp(f1) FILTER (tool = 1) / count(*) FILTER (tool = 1) AS vb FROM prf GROUP BY ALL),
      h AS (SELECT *, sqrt(va + vb) AS se, greatest(1, floor((va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)))) AS df FROM v),
      i AS (SELECT block, diff, CASE WHEN na >= 2 AND nb >= 2 THEN diff - CASE WHEN se = 0 THEN 0 ELSE {T_SQL.format('df')} * se END END AS lo, CASE WHEN na >= 2 AND nb >= 2 THEN diff + CASE WHEN se = 0 THEN 0 ELSE {T_SQL.format('df')} * se END END AS hi FROM h)
      SELECT *, CASE WHEN lo > 0 THEN 'a' WHEN hi < 0 THEN 'b' ELSE 'tie' END AS verdict FROM i"""),
    "a14_bootstrap": (a14, COUNTS + """, u AS (SELECT sheet, row_number() OVER (ORDER BY sheet) - 1 AS u FROM (SELECT DISTINCT sheet FROM counts)), n AS (SELECT count(*) AS n FROM u),
      p AS (SELECT d.range AS draw, ('0x' || substr(md5('b1|unit|' || d.range || '|' || s.range), 1, 8))::BIGINT % n AS u, ('0x' || substr(md5('b1|rep|' || d.range || '|' || s.range), 1, 8))::BIGINT % 2 AS r
        FROM range(500) d, n, range(10000) s WHERE s.range < n),
      v AS (SELECT draw, 2.0 * sum(tp) / (sum(predicted) + sum(in_key)) AS v FROM p JOIN u USING (u) JOIN counts c ON c.sheet = u.sheet AND c.tool = p.r GROUP BY draw)
      SELECT count(*) AS draws, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM v"""),
    "a15_wilson": (a15, "WITH s AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS c, (count(*) FILTER (l_discount > 0.05))::DOUBLE AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, c::BIGINT AS n, m::BIGINT AS mismatch, " + WILSON.format(k="m", n="c", s="-") + " AS lo, " + WILSON.format(k="m", n="c", s="+") + " AS hi FROM s"),
    "a15_weighted_rate": (a15_weighted, """WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS pop, count(*) FILTER (l_orderkey % 10 = 0) AS n, count(*) FILTER (l_orderkey % 10 = 0 AND l_discount > 0.05) AS bad FROM lineitem GROUP BY ALL)
      SELECT l_returnflag, sum(n)::BIGINT AS checked, sum(pop * bad / n) / sum(pop) AS rate FROM s WHERE n > 0 GROUP BY l_returnflag"""),
    "a16_reader_agreement": (a16, """WITH p AS (SELECT o_orderpriority AS source, o_orderkey % 2 AS reader, count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 9 <> 0) AS agree, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 9 <> 0) AS disagree, count(*) FILTER (o_orderkey % 9 = 0) AS unclear FROM orders GROUP BY ALL)
      SELECT *, """ + WILSON.format(k="agree::DOUBLE", n="(agree + disagree)", s="-") + " AS confidence FROM p"),
    "a17_caught_top_share": (a17, """WITH r AS (SELECT l_returnflag AS run, round(l_discount, 2) AS risk, count(*) AS n, count(*) FILTER (l_quantity > 25 + l_linenumber * 4) AS errors FROM lineitem GROUP BY ALL),
      t AS (SELECT run, errors, least(n, greatest(0, 0.2 * sum(n) OVER (PARTITION BY run) - coalesce(sum(n) OVER (PARTITION BY run ORDER BY risk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::DOUBLE * errors / n AS took FROM r)
      SELECT run, sum(errors)::BIGINT AS errors, sum(took) / sum(errors) AS caught FROM t GROUP BY run"""),
    "a18_green_cut": (a18, """WITH r AS (SELECT l_returnflag AS run, round(l_discount, 2) AS risk, count(*) AS n, count(*) FILTER (l_quantity > 25 + l_linenumber * 4) AS errors FROM lineitem GROUP BY ALL),
      c AS (SELECT run, risk, sum(errors) OVER w / sum(n) OVER w AS rate FROM r WINDOW w AS (PARTITION BY run ORDER BY risk)) SELECT run, max(risk) FILTER (rate <= 0.24) AS green_max FROM c GROUP BY run"""),
    "a19_logistic": (a19, None),
    "p19_risk_tiers": (p19, """WITH f AS (SELECT l_quantity / 50 * 1.5 AS q, l_discount * 10 AS d, l_tax * 10 * 0.75 AS t FROM lineitem),
      r AS (SELECT *, 1 / (1 + exp(-(-2.0 + q + d + t))) AS risk FROM f),
      w AS (SELECT risk, array_to_string(list_transform(list_reverse_sort(list_filter([{'v': q, 'n': 'quantity'}, {'v': d, 'n': 'discount'}, {'v': t, 'n': 'tax'}], lambda x: x.v > 0.25))[1:3], lambda x: x.n), '; ') AS why FROM r)
      SELECT CASE WHEN risk < 0.3 THEN 'green' WHEN risk >= 0.5 THEN 'red' ELSE 'amber' END AS tier, why, count(*) AS n FROM w GROUP BY ALL"""),
    "o04_stratified_sample": (o04, """WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS size FROM customer GROUP BY 1), b AS (SELECT *, least(2, size) AS l, size - least(2, size) AS room FROM s),
      w AS (SELECT *, greatest(0, least(60, sum(size) OVER ()) - sum(l) OVER ()) AS left_ FROM b), x AS (SELECT *, left_ * room / sum(room) OVER () AS want FROM w),
      y AS (SELECT *, left_ - sum(floor(want)) OVER () AS spare, row_number() OVER (ORDER BY want - floor(want) DESC, stratum) AS place FROM x),
      t AS (SELECT stratum, size, least(size, l + floor(want) + (place <= spare)::INT) AS take FROM y),
      r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s1' || c_custkey), c_custkey) AS k FROM customer)
      SELECT c_custkey, c_mktsegment, size / take AS weight FROM r JOIN t ON stratum = c_mktsegment WHERE k <= take"""),
    "w09_confidence_rank": (w09, WITH + """SELECT tool, sheet, id, CASE WHEN confidence IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY tool, sheet ORDER BY confidence DESC NULLS LAST) - 1) / count(confidence) OVER (PARTITION BY tool, sheet) END AS conf_rank FROM preds"""),
    "j20_run_agreement": (j20, WITH + """, q AS (SELECT a.tool, a.sheet, a.id, a.class, b.tool AS t2, b.id AS id2, b.class AS c2, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
        (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM preds a JOIN preds b ON a.sheet = b.sheet),
      s AS (SELECT *, i / (u - i) AS iou FROM q), o AS (SELECT sheet, count(DISTINCT tool) - 1 AS others FROM preds GROUP BY sheet)
      SELECT p.tool, p.sheet, p.id, CASE WHEN others = 0 THEN 0.5 ELSE 1 - (SELECT count(DISTINCT t2) FROM s WHERE s.sheet = p.sheet AND s.tool = p.tool AND s.id = p.id AND t2 <> p.tool AND c2 = s.class AND iou >= 0.1) / others END AS xm_miss,
        EXISTS (SELECT 1 FROM s WHERE s.sheet = p.sheet AND s.tool = p.tool AND s.id = p.id AND t2 = p.tool AND id2 <> p.id AND iou >= 0.5) AS dup_box FROM preds p JOIN o USING (sheet)"""),
    "j10_nearest_parent": (j10, WITH + f""", c AS (SELECT a.sheet, a.id, b.id AS nearest, {GAPS} AS gap FROM keys a JOIN keys b ON a.sheet = b.sheet AND a.class = 'instrument' AND b.class IN ('pump', 'tank') WHERE {GAPS} <= 120)
      SELECT sheet, id, nearest, gap FROM (SELECT *, row_number() OVER (PARTITION BY sheet, id ORDER BY gap, nearest) AS k FROM c) WHERE k = 1"""),
    "j21_class_outcomes": (j21, WITH + """SELECT t.tool, k.sheet, CASE WHEN p.class IS NULL THEN 'missed' WHEN p.class = k.class THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n
      FROM keys k CROSS JOIN (VALUES (0), (1)) AS t(tool) LEFT JOIN preds p ON p.tool = t.tool AND p.id = k.id GROUP BY ALL"""),
    "j10_parents": (j10_parents, None),
    "j22_identifier_contained": (j22, """WITH n AS (SELECT p_partkey // 40 AS g, p_name, (p_size % 3)::VARCHAR AS class FROM part), l AS (SELECT DISTINCT g, split_part(p_name, ' ', 2) AS identifier, class FROM n),
      h AS (SELECT l.g, l.identifier, l.class, count(n.p_name) AS hits, coalesce(bool_or(n.class = l.class), false) AS class_agrees FROM l LEFT JOIN n ON n.g = l.g AND contains(n.p_name, l.identifier) AND l.identifier <> '' GROUP BY ALL)
      SELECT *, hits > 0 AS found FROM h"""),
    "j23_point_match": (j23, None),
    "j26_actuator_roles": (j26, WITH + f""", c AS (SELECT a.sheet, a.id, b.id AS valve, {GAPS} AS gap FROM keys a JOIN keys b ON a.sheet = b.sheet AND a.class = 'instrument' AND b.class = 'valve'
        WHERE {GAPS} <= 60 AND abs((a.x0 + a.x1 - b.x0 - b.x1) / 2) <= (b.x1 - b.x0) / 2 AND a.x1 - a.x0 <= b.x1 - b.x0)
      SELECT sheet, id, valve, 'actuator' AS role FROM (SELECT *, row_number() OVER (PARTITION BY sheet, id ORDER BY gap, valve) AS k FROM c) WHERE k = 1"""),
    "j28_tile_merge": (j28, None),
    "j29_link_transfer": (j29, None),
    "u01_pair_sets": (u01, """WITH o AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity < 30), t AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity > 20),
      r AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, true AS ok FROM lineitem WHERE l_discount > 0.03),
      c AS (SELECT *, 'added' AS change FROM (SELECT * FROM t EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM t))
      SELECT change, coalesce(ok, false) AS "right", count(*) AS n FROM c LEFT JOIN r USING (a, b) GROUP BY ALL"""),
    "u02_regenerate_compare": (u02, "SELECT DISTINCT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 'GAP' WHEN '1-URGENT' THEN 'DIFF' ELSE 'MATCH' END AS state FROM orders"),
    "u03_missing_extra": (u03, """WITH p AS (SELECT p_partkey AS id FROM part), l AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45)
      SELECT id, 'missing' AS side FROM p WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT id, 'extra' FROM l WHERE id NOT IN (SELECT id FROM p)"""),
}
