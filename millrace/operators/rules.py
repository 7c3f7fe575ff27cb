"""Rule questions over items and their relations.

Items have the columns id, kind, tag, unit (the id of the equipment they
belong to), stream, sheet, text, measurement (a tag) and outputs (tags);
streams have stream, src and dst (ids of equipment). Whether an anchor has a
related candidate is decided by equal keys; the two relations that hold for
nearly all pairs (anywhere, other_unit) are decided by counts, so no pairs of
them are ever made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import graphs as G


@dataclass
class Model:
    items: DataFrame
    streams: DataFrame
    links: DataFrame  # (a, b): drawn links between items
    media: dict[str, str]  # name of a medium: pattern of the texts that speak of it


def own_unit() -> Column:
    """The equipment an item is or belongs to."""
    return F.when(F.col("kind") == "equipment", F.col("id")).otherwise(F.col("unit"))


def media_of(text: Column, media: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in media.items()]))


def matching(items: DataFrame, select: dict) -> DataFrame:
    """Items that a selector admits: kind (list), text, text_all, not_text (patterns of the text), tag (pattern), tagged."""
    tests = [F.lit(True)]
    if "kind" in select:
        tests.append(F.col("kind").isin(*select["kind"]))
    tests += [F.col("text").rlike(f"(?i){p}") for p in [*select.get("text_all", []), *([select["text"]] if "text" in select else [])]]
    if "not_text" in select:
        tests.append(~F.col("text").rlike(f"(?i){select['not_text']}"))
    if "tag" in select:
        tests.append(F.col("tag").rlike(f"(?i){select['tag']}"))
    if select.get("tagged"):
        tests.append(F.coalesce(F.col("tag"), F.lit("")) != "")
    return items.where(reduce(lambda a, b: a & b, tests))


def pairs(model: Model, anchors: DataFrame, candidates: DataFrame, relation: str, max_hops: int = 2) -> DataFrame:
    """``(anchor, id)``: the candidates of each anchor by a relation that names its partners; an anchor is not its own.

    The relations: same_stream, same_unit, same_unit_same_medium, drives (a
    controller writes to the anchor), reads (a controller or interlock reads
    it), linked (joined to its unit by a stream), discharge_side (on a stream
    that leaves its unit) and near (within ``max_hops`` drawn links on its
    sheet, not through other equipment).
    """
    a = anchors.select(F.col("id").alias("anchor"), own_unit().alias("a_unit"), F.col("stream").alias("a_stream"), F.col("sheet").alias("a_sheet"), T.tag_lenient(F.col("tag")).alias("a_tag"), media_of(F.col("text"), model.media).alias("a_media"))
    c = candidates.select("id", "kind", "unit", "stream", "sheet", "measurement", "outputs", media_of(F.col("text"), model.media).alias("media"))
    by_unit = c.where("unit is not null").select("*", F.col("unit").alias("key")).unionByName(c.where("kind = 'equipment'").select("*", F.col("id").alias("key")))
    on_unit = a.join(by_unit, F.col("a_unit") == F.col("key"))
    on_stream = a.join(c, F.col("a_stream") == F.col("stream"))
    if relation == "same_stream":
        out = on_stream
    elif relation == "same_unit":
        out = on_unit
    elif relation == "same_unit_same_medium":
        keep = ["anchor", "id", "media", "a_media"]
        in_unit = on_unit.where("unit is not null and unit = a_unit").select(*keep)
        out = in_unit.unionByName(on_stream.where("a_unit is not null").select(*keep)).where(F.arrays_overlap("media", "a_media"))
    elif relation == "drives":
        written = c.where("kind = 'controller'").select("id", F.explode("outputs").alias("tag"))
        out = a.join(written, F.col("a_tag") == T.tag_lenient(F.col("tag")))
    elif relation == "reads":
        out = a.join(c.where("kind in ('controller', 'interlock')"), F.col("a_tag") == T.tag_lenient(F.col("measurement")))
    elif relation in ("linked", "discharge_side"):
        s = model.streams
        leaves = s.select(F.col("src").alias("at"), F.col("stream").alias("via"), F.col("dst").alias("other"))
        ends = leaves if relation == "discharge_side" else leaves.unionByName(s.select(F.col("dst").alias("at"), F.col("stream").alias("via"), F.col("src").alias("other")))
        touched = a.join(ends, F.col("a_unit") == F.col("at"))
        along = touched.join(c.where("kind <> 'equipment'") if relation == "linked" else c, F.col("via") == F.col("stream")).select("anchor", "id")
        out = along if relation == "discharge_side" else along.unionByName(touched.join(c.where("kind = 'equipment'"), F.col("other") == F.col("id")).select("anchor", "id"))
    elif relation == "near":
        sheet = model.items.select("id", "sheet")
        e = model.links.join(sheet.select(F.col("id").alias("a"), F.col("sheet").alias("s")), "a").join(sheet.select(F.col("id").alias("b"), F.col("sheet").alias("t")), "b").where("s = t").select("a", "b")
        reached = G.hops(anchors.select("id"), e, max_hops, blocked=model.items.where("kind = 'equipment'"))
        out = reached.select(F.col("start").alias("anchor"), "id").join(c.select("id"), "id")
    else:
        raise ValueError(f"{relation} does not name partners")
    return out.select("anchor", "id").where("anchor <> id").distinct()


def having(model: Model, anchors: DataFrame, clause: dict) -> DataFrame:
    """``(anchor)``: the anchors that have a candidate of a clause: its ``select``, ``relation`` and ``max_hops``."""
    candidates, relation = matching(model.items, clause["select"]), clause.get("relation", "same_unit")
    if relation not in ("anywhere", "other_unit"):
        return pairs(model, anchors, candidates, relation, clause.get("max_hops", 2)).select("anchor").distinct()
    own = anchors.select("id", own_unit().alias("u"))
    mine = candidates.select(F.col("id").alias("c"), F.lit(1).alias("self"), F.col("unit").alias("c_unit"))
    marked = own.join(mine, own["id"] == mine["c"], "left")
    if relation == "anywhere":
        total = candidates.agg(F.count("*").alias("total"))  # one row
        return marked.join(F.broadcast(total), how="cross").where(F.col("total") - F.coalesce("self", F.lit(0)) > 0).select(F.col("id").alias("anchor"))
    placed = candidates.where("unit is not null")
    total, by = placed.agg(F.count("*").alias("total")), placed.groupBy(F.col("unit").alias("by")).agg(F.count("*").alias("same"))
    counted = marked.where("u is not null").join(by, F.col("u") == F.col("by"), "left").join(F.broadcast(total), how="cross")
    # An anchor is no candidate of its own: equipment may stand in another unit than itself.
    alone = F.when(F.col("c_unit").isNotNull() & (F.col("c_unit") != F.col("u")), 1).otherwise(0)
    return counted.where(F.col("total") - F.coalesce("same", F.lit(0)) - alone > 0).select(F.col("id").alias("anchor"))


def run(model: Model, question: dict) -> DataFrame:
    """``(question, place, anchors, first_tag, shown)``: the findings of one question.

    An anchor has every ``with`` clause and no ``without`` match. ``also_show``
    clauses are counted but not demanded. ``group_by`` is unit, item or model;
    a group needs ``min_anchors``, and a unit whose text matches
    ``unit_not_text`` rules its group out. A line (no unit) is ruled out only
    if all equipment at its ends matches. Without an item of each kind that
    ``needs_model`` names there is no finding.
    """
    anchors = matching(model.items, question["anchor"])
    for kind in question.get("needs_model", []):
        anchors = anchors.join(model.items.where(F.col("kind") == kind).limit(1).select(F.lit(1).alias("_there")), how="cross").drop("_there")
    for clause in question.get("with", []):
        anchors = anchors.join(having(model, anchors, clause).withColumnRenamed("anchor", "_a"), F.col("id") == F.col("_a"), "left_semi")
    for clause in question.get("without", []):
        anchors = anchors.join(having(model, anchors, clause).withColumnRenamed("anchor", "_a"), F.col("id") == F.col("_a"), "left_anti")
    by = question.get("group_by", "unit")
    place = {"unit": F.coalesce(own_unit(), F.col("id")), "item": F.col("id"), "model": F.lit(None).cast(model.items.schema["id"].dataType)}[by]
    placed = anchors.select("id", "tag", "stream", place.alias("place"))
    if "unit_not_text" in question:
        ruled = model.items.where((F.col("kind") == "equipment") & F.col("text").rlike(f"(?i){question['unit_not_text']}")).select(F.col("id").alias("_u"), F.lit(True).alias("_out"))
        equipment = model.items.where("kind = 'equipment'").select(F.col("id").alias("_e"))
        at = placed.join(equipment, F.col("place") == F.col("_e"), "left").join(ruled, F.col("place") == F.col("_u"), "left")
        ends = model.streams.select("stream", F.explode(F.array("src", "dst")).alias("_end")).join(equipment, F.col("_end") == F.col("_e")).join(ruled, F.col("_end") == F.col("_u"), "left")
        lines = ends.groupBy(F.col("stream").alias("_s")).agg(F.min(F.coalesce("_out", F.lit(False))).alias("_all"))
        per = at.join(lines, F.col("stream") == F.col("_s"), "left")
        out = F.when(F.col("_e").isNotNull(), F.coalesce("_out", F.lit(False))).otherwise(F.coalesce("_all", F.lit(False)))
        gone = per.groupBy("place").agg(F.min(out).alias("gone")).where("gone").select(F.col("place").alias("_p"))
        placed = placed.join(gone, F.col("place").eqNullSafe(F.col("_p")), "left_anti")
    shown = [pairs(model, anchors, matching(model.items, c["select"]), c.get("relation", "same_unit"), c.get("max_hops", 2)) for c in question.get("also_show", [])]
    found = placed.groupBy("place").agg(F.count_distinct("id").alias("anchors"), F.min("tag").alias("first_tag")).where(F.col("anchors") >= question.get("min_anchors", 1))
    if shown:
        seen = reduce(DataFrame.unionByName, shown).join(placed.select(F.col("id").alias("anchor"), "place"), "anchor")
        beside = seen.join(placed.select(F.col("id").alias("_i"), F.col("place").alias("_q")), (F.col("id") == F.col("_i")) & F.col("place").eqNullSafe(F.col("_q")), "left_anti")
        counts = beside.groupBy(F.col("place").alias("_p")).agg(F.count_distinct("id").alias("shown"))
        found = found.join(counts, F.col("place").eqNullSafe(F.col("_p")), "left")
    else:
        found = found.withColumn("shown", F.lit(0))
    return found.select(F.lit(question["id"]).alias("question"), F.col("place").cast("string").alias("place"), "anchors", "first_tag", F.coalesce(F.col("shown"), F.lit(0)).cast("long").alias("shown"))


def run_all(model: Model, catalog: list[dict]) -> DataFrame:
    return reduce(DataFrame.unionByName, [run(model, q) for q in catalog])


def site_rollup(screens: DataFrame, findings: DataFrame) -> DataFrame:
    """``(question, fired, findings, fired_at, quiet_at, not_checked_at, not_run_at, place)`` of several sites' screens.

    ``screens(site, question, status)`` has a row for each question that a site
    ran, status ``quiet`` or ``not checked`` where it did not fire; ``findings(site,
    question, finding)`` what fired. A question that a site neither ran nor
    fired is not run there. Place orders questions by sites, findings and id.
    """
    ran = screens.select("site", "question", "status").distinct()
    fired = findings.groupBy("site", "question").agg(F.count_distinct("finding").alias("n"))
    state = ran.join(fired, ["site", "question"], "full").groupBy("site", "question").agg(F.max("n").alias("n"), F.max(F.col("status") == "quiet").alias("quiet"), F.max(F.col("status") == "not checked").alias("unchecked"))
    names = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("site"))))
    per = state.groupBy("question").agg(
        F.count("n").alias("fired"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), names(F.col("n").isNotNull()).alias("fired_at"),
        names(F.col("n").isNull() & F.col("quiet")).alias("quiet_at"), names(F.coalesce("unchecked", F.lit(False))).alias("not_checked_at"), F.collect_set("site").alias("seen"),
    )
    # Windows over a row a question; sites are few, as they are listed in every row anyway.
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen").over(Window.partitionBy(F.lit(1))))))
    place = F.row_number().over(Window.orderBy(F.desc("fired"), F.desc("findings"), "question"))
    return per.withColumn("every", every).select("question", "fired", "findings", "fired_at", "quiet_at", "not_checked_at", F.array_except("every", "seen").alias("not_run_at"), place.alias("place"))


def merged_requests(requests: DataFrame) -> DataFrame:
    """``(question, item, site, place, finding)``: the places where data is asked for, of ``requests(site, question, finding, item, place)``.

    A place that every finding of a site asks for, for one question and item,
    is listed once, with a null finding; the others are listed with theirs.
    """
    own = requests.distinct()
    by = ["site", "question", "item"]
    whole = own.groupBy(*by).agg(F.count_distinct("finding").alias("of"))
    places = own.where("place is not null").groupBy(*by, "place").agg(F.count_distinct("finding").alias("has")).join(whole, by)
    shared = places.where("has = of").select("question", "item", "site", "place", F.lit(None).cast(own.schema["finding"].dataType).alias("finding"))
    rest = own.where("place is not null").join(places.where("has = of"), [*by, "place"], "left_anti")
    return shared.unionByName(rest.select("question", "item", "site", "place", "finding"))
