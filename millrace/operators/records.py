"""Mapping, audits, rule queries, ledgers and reports over item tables.

Every check returns rows: what is wrong is data, and an update is applied only
where its table of refusals is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import written

# ---- mapping


def map_points(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Each list row is mapped, ambiguous, or not on the drawing; each item without a row is not in the list."""
    counted = items.groupBy(key).agg(F.count("*").alias("_n"), F.min("id").alias("asset"))
    joined = rows.join(counted, key, "left")
    outcome = F.when(F.col("_n").isNull(), "not on drawing").when(F.col("_n") > 1, "ambiguous").otherwise("mapped")
    mapped = joined.select(key, F.col("row").alias("row"), F.when(F.col("_n") == 1, F.col("asset")).alias("asset"), outcome.alias("outcome"))
    left = items.join(rows.select(key).distinct(), key, "left_anti").select(key, F.lit(None).cast("long").alias("row"), F.col("id").alias("asset"), F.lit("not in list").alias("outcome"))
    return mapped.unionByName(left)


def plan_mapping(rows: DataFrame, items: DataFrame, sheets: list | None = None) -> DataFrame:
    """``(row, asset, how, outcome)`` of a point list ``(row, tag, asset_id, server, base_path, point)`` against ``items(id, tag, sheet, rejected, placeholder)``.

    A pinned asset_id never falls back to the tag. Tags meet in their mapping
    spelling; placeholders and rejected items hold none. Items of the sheets
    in question that no row maps are not in the list.
    """
    from millrace.functions.text import tag_map

    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    active = items.where(~F.col("rejected"))
    by_tag = active.where(~F.col("placeholder") & ~blank("tag")).groupBy(tag_map(F.col("tag")).alias("_key")).agg(F.count("*").alias("_n"), F.min("id").alias("_one"))
    by_id = active.select(F.col("id").alias("_pinned"), F.col("id").cast("string").alias("_pin"))
    asked = rows.withColumn("_p", F.when(~blank("asset_id"), F.trim("asset_id"))).withColumn("_k", F.when(F.col("_p").isNull() & ~blank("tag"), tag_map(F.col("tag"))))
    met = asked.join(by_id, F.col("_p") == F.col("_pin"), "left").join(by_tag, F.col("_k") == F.col("_key"), "left")
    target = F.coalesce("_pinned", F.when(F.col("_n") == 1, F.col("_one")))
    placed = met.withColumn("asset", target).join(items.select(F.col("id").alias("asset"), F.col("sheet").alias("_sheet")), "asset", "left")
    outside = ~F.col("_sheet").isin(sheets) if sheets is not None else F.lit(False)
    first = (
        F.when(F.col("_p").isNull() & F.col("_k").isNull(), "refused: tag or asset id is needed")
        .when(blank("server") | blank("base_path") | blank("point"), "refused: address is blank")
        .when(F.col("_p").isNotNull() & F.col("_pinned").isNull(), "refused: unknown or rejected asset id")
        .when(F.col("_p").isNull() & F.col("_n").isNull(), "not on drawing")
        .when(F.col("_p").isNull() & (F.col("_n") > 1), "ambiguous")
        .when(outside, "refused: outside the sheets")
        .otherwise("mapped")
    )
    told = placed.withColumn("_o", first)
    again = F.row_number().over(Window.partitionBy("_o", F.when(F.col("_o") == "mapped", F.col("asset")).otherwise(F.col("row"))).orderBy("row")) > 1
    done = told.select("row", F.when(F.col("_o") == "mapped", F.col("asset")).alias("asset"), F.when(F.col("_p").isNotNull(), "asset id").otherwise("tag").alias("how"), F.when((F.col("_o") == "mapped") & again, "refused: target given twice").otherwise(F.col("_o")).alias("outcome"))
    done = done.withColumn("asset", F.when(F.col("outcome") == "mapped", F.col("asset")))
    scope = active if sheets is None else active.where(F.col("sheet").isin(sheets))
    rest = scope.join(done.where("asset is not null").select(F.col("asset").alias("id")), "id", "left_anti")
    return done.unionByName(rest.select(F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("id").alias("asset"), F.lit(None).cast("string").alias("how"), F.lit("not in list").alias("outcome")))


def mapping_applies(plan: DataFrame, replace_all: bool = False) -> bool:
    """Whether a plan may be applied: never with a refused row, and as a full replacement only if every row resolves."""
    stops = F.col("outcome").startswith("refused")
    return plan.where(stops | F.col("outcome").isin("ambiguous", "not on drawing") if replace_all else stops).isEmpty()


def mapped_items(items: DataFrame, rows: DataFrame, plan: DataFrame, sheets: list | None = None, replace_all: bool = False) -> DataFrame:
    """``items`` with ``data_point`` as the plan has it; unchanged where it does not apply. A full replacement drops the points of other items in its sheets."""
    if not mapping_applies(plan, replace_all):
        return items
    given = plan.where("outcome = 'mapped'").join(rows, "row").select(F.col("asset").alias("_a"), F.struct("server", "base_path", "point").alias("_point"))
    joined = items.join(given, F.col("id") == F.col("_a"), "left")
    inside = F.lit(True) if sheets is None else F.col("sheet").isin(sheets)
    kept = F.when(inside & ~F.col("rejected"), F.lit(None)).otherwise(F.col("data_point")) if replace_all else F.col("data_point")
    return joined.withColumn("data_point", F.coalesce("_point", kept)).drop("_a", "_point")


def checked_streams(streams: DataFrame, allowed: DataFrame) -> DataFrame:
    """``(id, result, fix)`` of ``streams(id, number, a, b)`` against the segments ``allowed(number, a, b)`` of their number.

    Confirmed as drawn; corrected by turning it round, or by the one segment
    that shares an end with it; else unresolvable.
    """
    seg = allowed.select(F.col("number").alias("_n"), F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    j = streams.join(seg, F.col("number") == F.col("_n"), "left")
    same, turned = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), (F.col("a") == F.col("_b")) & (F.col("b") == F.col("_a"))
    fits = (F.col("a") == F.col("_a")) | (F.col("b") == F.col("_b"))
    one = F.when(F.col("a") != F.col("_a"), F.concat(F.lit("from "), "_a")).otherwise(F.concat(F.lit("to "), "_b"))
    per = j.groupBy("id").agg(F.max(F.coalesce(same, F.lit(False))).alias("same"), F.max(F.coalesce(turned, F.lit(False))).alias("turned"), F.count_if(fits).alias("fits"), F.max(F.when(fits, one)).alias("one"))
    result = F.when(F.col("same"), "confirmed").when(F.col("turned") | (F.col("fits") == 1), "corrected").otherwise("unresolvable")
    return per.select("id", result.alias("result"), F.when(~F.col("same"), F.when(F.col("turned"), "reversed").when(F.col("fits") == 1, F.col("one"))).alias("fix"))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Ids added, removed and changed between two snapshots."""
    b = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_b"))
    a = after.select(key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    j = b.join(a, key, "full")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return j.where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select(key, kind.alias("change"), "before", "after")


def renamed(items: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items under their new tags with the former ones kept, and the clashes that refuse the update.

    A clash is a new tag that an item outside the mapping holds, or that two rows of the mapping give.
    """
    m = mapping.select(F.col("old").alias("_old"), "new")
    out = items.join(m, F.col("tag") == F.col("_old"), "left").withColumn("former_tag", F.when(F.col("new").isNotNull(), F.col("tag"))).withColumn("tag", F.coalesce("new", "tag")).drop("_old", "new")
    held = items.join(m, items["tag"] == m["_old"], "left_anti").select(F.col("tag").alias("new"))
    taken = mapping.join(held, "new", "left_semi").select("new", F.lit("held by another item").alias("why"))
    twice = mapping.groupBy("new").count().where("count > 1").select("new", F.lit("given twice").alias("why"))
    return out, taken.unionByName(twice).distinct()


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """Named checks, each a table with an ``id``, as one table."""
    rows = [df.select(F.lit(name).alias("check"), F.col("id").cast("string").alias("id")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def one_to_one(items: DataFrame, tags: DataFrame, key: str) -> DataFrame:
    """Items without exactly one tag and tags without an item."""
    i = items.groupBy(key).agg(F.count("*").alias("items"))
    t = tags.groupBy(key).agg(F.count("*").alias("tags"))
    j = i.join(t, key, "full").select(key, F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("tags", F.lit(0)).alias("tags"))
    return j.where("items <> 1 or tags <> 1").withColumn("finding", F.when(F.col("tags") == 0, "no tag").when(F.col("items") == 0, "no item").otherwise("not one to one"))


def freshness(recorded: DataFrame, current: DataFrame, upstream: DataFrame) -> DataFrame:
    """FRESH, STALE, NEVER BUILT or MISSING by hashes ``(stage, hash)``; a stage below a stale one is stale."""
    from millrace.operators.graphs import descendants

    j = recorded.select("stage", F.col("hash").alias("was"), F.lit(True).alias("_r")).join(current.select("stage", F.col("hash").alias("now"), F.lit(True).alias("_c")), "stage", "full")
    own = j.select("stage", F.when(F.col("_r").isNull(), "NEVER BUILT").when(F.col("_c").isNull(), "MISSING").when(F.col("was").eqNullSafe(F.col("now")), "FRESH").otherwise("STALE").alias("state"))
    below = descendants(upstream, own.where("state <> 'FRESH'").select(F.col("stage").alias("id"))).select(F.col("id").alias("stage"), F.lit(True).alias("_below")).distinct()
    return own.join(below, "stage", "left").select("stage", F.when((F.col("state") == "FRESH") & F.col("_below"), "STALE").otherwise(F.col("state")).alias("state"))


# ---- rule queries


def selector(spec: dict) -> Column:
    """One catalog entry as a condition on items.

    Keys: kind (list), text, not_text (patterns on tag), unit_min, unit_max,
    price_min, price_max, field and state (present, blank, absent).
    """
    from millrace.functions.text import field_state

    tests: list[Column] = [F.lit(True)]
    if "kind" in spec:
        tests.append(F.col("kind").isin(*spec["kind"]))
    if "text" in spec:
        tests.append(F.col("tag").rlike(f"(?i){spec['text']}"))
    if "not_text" in spec:
        tests.append(~F.col("tag").rlike(f"(?i){spec['not_text']}"))
    for name in ("unit", "price", "size"):
        if f"{name}_min" in spec:
            tests.append(F.col(name) >= spec[f"{name}_min"])
        if f"{name}_max" in spec:
            tests.append(F.col(name) <= spec[f"{name}_max"])
    if "field" in spec:
        tests.append(field_state(F.col(spec["field"])) == spec.get("state", "present"))
    return reduce(lambda a, b: a & b, tests)


def ask(items: DataFrame, question: dict) -> DataFrame:
    """Anchors with every ``with`` clause and no ``without`` match, grouped by the relation column.

    A clause is a selector and the columns (``on``) that relate a candidate to
    its anchor; an anchor is no candidate of its own. Groups need
    ``min_anchors``.
    """
    anchors = items.where(selector(question["anchor"]))

    def related(clause: dict) -> DataFrame:
        cand = items.where(selector(clause["match"]))
        return cand.select(*[F.col(c).alias(f"_{c}") for c in clause["on"]], F.col("id").alias("_id"))

    def same(left: DataFrame, clause: dict, right: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [left[c] == right[f"_{c}"] for c in clause["on"]], left["id"] != right["_id"])

    for clause in question.get("with", []):
        cand = related(clause)
        anchors = anchors.join(cand, same(anchors, clause, cand), "left_semi")
    for clause in question.get("without", []):
        cand = related(clause)
        anchors = anchors.join(cand, same(anchors, clause, cand), "left_anti")
    by = question["group"]
    found = anchors.groupBy(by).agg(F.count("*").alias("anchors"), F.min("tag").alias("first_tag"))
    return found.where(F.col("anchors") >= question.get("min_anchors", 1)).select(F.lit(question["id"]).alias("question"), F.col(by).cast("string").alias("place"), "anchors", "first_tag")


def screen(items: DataFrame, catalog: list[dict]) -> DataFrame:
    """All questions of a catalog as one union."""
    return reduce(DataFrame.unionByName, [ask(items, q) for q in catalog])


def requests(subjects: DataFrame, fields: list[str]) -> DataFrame:
    """Per place and field whether every subject has it, and how many still need it; met requests are dropped."""
    from millrace.functions.text import field_state

    states = subjects.select("place", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), field_state(F.col(f).cast("string")).alias("state")) for f in fields])).alias("s")).select("place", "s.*")
    per = states.groupBy("place", "field").agg(F.count("*").alias("subjects"), F.count_if(F.col("state") != "present").alias("still_needed"))
    return per.where("still_needed > 0")


# ---- claims


def flattened(records: DataFrame, owner: str, json: str) -> DataFrame:
    """Every scalar of a nested JSON record as ``(owner, name, value)``; dotted names, list places in brackets.

    Levels are exploded one by one until none is left, each from a written table.
    """
    level = written(records.select(F.col(owner).alias("owner"), F.lit("").alias("name"), F.parse_json(F.col(json)).alias("v")), "level")
    done: DataFrame | None = None
    while True:
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        flat = level.where(~nested).select("owner", "name", F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")).alias("value"))
        done = flat if done is None else done.unionByName(flat)
        below = level.where(nested)
        if below.isEmpty():
            return done
        parts = below.lateralJoin(below.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("key").isNull(), F.concat("name", F.lit("["), "pos", F.lit("]"))).when(F.col("name") == "", F.col("key")).otherwise(F.concat("name", F.lit("."), "key"))
        level = written(parts.select("owner", name.alias("name"), F.col("value").alias("v")), "level")


def status_of(*candidates: Column) -> Column:
    """The first status given, else unverified."""
    return F.coalesce(*candidates, F.lit("unverified"))


def profile(claims: DataFrame, core: str) -> tuple[DataFrame, DataFrame]:
    """Claims whose name without list places matches, and a count of the others by name."""
    plain = F.regexp_replace("name", r"\[\d+\]", "")
    keep = plain.rlike(core)
    return claims.where(keep), claims.where(~keep).groupBy(plain.alias("name")).agg(F.count("*").alias("dropped"))


def safety_class(tag: Column) -> Column:
    """P10: the protective function a tag reads as, by an ordered rule table; null for none."""
    letters = F.regexp_extract(F.upper(tag), r"^([A-Z]+)", 1)
    rules = (("relief", r"^[A-Z]S[EV]$|^PRV$"), ("shutdown", r"^(ESD|XV|SDV|BDV)$"), ("trip", r"^[A-Z]D?(S|A)(HH|LL|HL)$"), ("isolation", r"(IV|ISV)$"))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(letters.rlike(pattern), name).otherwise(out)
    return out


# ---- ledgers


def latest(decisions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest decision of each key, with the number of its predecessor."""
    w = Window.partitionBy(*keys).orderBy(*order)
    chained = decisions.withColumn("previous", F.lag("decision_id").over(w)).withColumn("_last", F.lead("decision_id").over(w).isNull())
    return chained.where("_last").drop("_last")


def apply_review(items: DataFrame, sheet: DataFrame, actions: tuple[str, ...] = ("confirm", "correct", "reject")) -> DataFrame:
    """The outcome of every row of a review sheet ``(id, action, value)`` against ``items(id, value)``.

    Refusals come first, in order; a correction to the held value is a no-op.
    """
    held = items.select(F.col("id").alias("_id"), F.col("value").alias("held"))
    j = sheet.join(held, F.col("id") == F.col("_id"), "left")
    outcome = (
        F.when(F.col("_id").isNull(), "refused: unknown id")
        .when(~F.col("action").isin(*actions), "refused: unknown action")
        .when((F.col("action") == "correct") & (F.coalesce(F.trim("value"), F.lit("")) == ""), "refused: no value")
        .when((F.col("action") == "correct") & (F.col("value") == F.col("held")), "no change")
        .otherwise(F.col("action"))
    )
    return j.select("id", "action", "value", "held", outcome.alias("outcome"))


def verdict_status(source_match: Column, plant_truth: Column) -> Column:
    """The status two verdicts give."""
    return (
        F.when(source_match == "mismatch", "rejected")
        .when((source_match == "match") & (plant_truth == "true"), "verified")
        .when((source_match == "match") & (plant_truth == "false"), "disputed")
        .when(source_match == "match", "source_checked")
        .otherwise("unverified")
    )


def register_state(decisions: DataFrame, key: str) -> DataFrame:
    """Disputed, answered, needs_data, partial or unanswered for each question."""
    per = decisions.groupBy(key).agg(
        F.count_distinct(F.when(F.col("decision") == "accept", F.col("value"))).alias("values"),
        F.count_if(F.col("decision") == "accept").alias("accepted"),
        F.count_if(F.col("decision") == "needs_data").alias("needs"),
        F.count("*").alias("n"),
    )
    state = F.when(F.col("values") > 1, "disputed").when(F.col("needs") > 0, "needs_data").when(F.col("accepted") == F.col("n"), "answered").when(F.col("accepted") > 0, "partial").otherwise("unanswered")
    return per.select(key, state.alias("state"), "accepted", "n")


# ---- reports


def queue_order() -> list[Column]:
    """The review order: tier, falling risk, confidence (null first), id."""
    tier = F.when(F.col("tier") == "red", 0).when(F.col("tier") == "amber", 1).otherwise(2)
    return [tier, F.desc("risk"), F.coalesce("confidence", F.lit(-1.0)), F.col("id")]


def best_per_key(records: DataFrame, by: str, key: str, score: str, tie: str, top: int = 8) -> DataFrame:
    """The best record of each key, then the top of each group."""
    one = records.withColumn("_k", F.row_number().over(Window.partitionBy(by, key).orderBy(F.desc(score), tie))).where("_k = 1").drop("_k")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("place") <= top)


def page(rows: DataFrame, needle: str, fields: list[str], order: list[str], limit: int, offset: int) -> DataFrame:
    """One page of rows that hold a text in any field, case folded, with the number of all that do."""
    hits = rows.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle.lower())))
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # total: one row
