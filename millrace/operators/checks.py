"""Comparisons and classifications over item, loop, claim and result tables.

Each function takes tables with the stated columns and gives rows; nothing is
decided by what a table is called or where it comes from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- classifications


def first_rule(rules: Sequence[tuple[str, Column]], default: str | None) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(default)
    for name, condition in reversed(list(rules)):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def first_source(candidates: Sequence[tuple[str, Column]]) -> Column:
    """struct<text, source> of the first candidate that is given."""
    return F.coalesce(*[F.when(text.isNotNull(), F.struct(text.alias("text"), F.lit(source).alias("source"))) for source, text in candidates])


def three_state(value: Column, error: Column, limit: Column, side: Column) -> Column:
    """Met, clear or uncertain for a reading with an error bound either way; no reading for null. ``side`` is below or above."""
    lo, hi = value - error, value + error
    below = F.when(hi < limit, "met").when(lo >= limit, "clear").otherwise("uncertain")
    above = F.when(lo > limit, "met").when(hi <= limit, "clear").otherwise("uncertain")
    return F.when(value.isNull(), "no reading").when(side == "below", below).otherwise(above)


def channels(items: DataFrame, parts: str) -> DataFrame:
    """``items(id, tag)`` with a row per channel: the tag itself for the first, ``tag-n`` for the n-th of ``parts``."""
    each = items.select("id", "tag", F.posexplode(F.sequence(F.lit(1), F.col(parts).cast("int"))).alias("pos", "part"))
    return each.select("id", F.when(F.col("pos") > 0, F.concat("tag", F.lit("-"), F.col("part").cast("string"))).otherwise(F.col("tag")).alias("channel"), "pos")


def unit_findings(own: Column, usual: Column) -> Column:
    """What is wrong with an item's unit, given its own and that of its kind."""
    return F.when(own.isNull() & usual.isNull(), "no unit").when(own != usual, "units differ")


# ---- audits


def tags_present(loops: DataFrame, tags: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each loop with a ``has_<column>`` for each tag column (compact spelling) among ``tags(tag)``, and its status."""
    from millrace.functions.text import tag_compact

    held = tags.select(tag_compact(F.col("tag")).alias("_k")).distinct().withColumn("_here", F.lit(True))
    out = loops
    for c in columns:
        out = out.withColumn("_t", tag_compact(F.col(c))).join(held, F.col("_t") == F.col("_k"), "left").withColumn(f"has_{c}", F.coalesce("_here", F.lit(False))).drop("_t", "_k", "_here")
    has = [F.col(f"has_{c}") for c in columns]
    every, some = reduce(lambda a, b: a & b, has), reduce(lambda a, b: a | b, has)
    return out.withColumn("status", F.when(every, "tags_present").when(some, "partly").otherwise("not found"))


def numbering(members: DataFrame) -> DataFrame:
    """``members(loop, number)``: per loop how many tags and different numbers it has, and whether it has one."""
    per = members.groupBy("loop").agg(F.count_distinct("number").alias("numbers"), F.count("*").alias("tags"))
    return per.withColumn("one_number", F.col("numbers") == 1)


def sheet_identity(items: DataFrame) -> DataFrame:
    """The system most of a sheet's ``items(sheet, system)`` belong to and how many that are; a tie is unknown."""
    per = items.groupBy("sheet", "system").agg(F.count("*").alias("n"))
    most = per.groupBy("sheet").agg(F.max("n").alias("most"))
    top = per.join(most, "sheet").where("n = most")
    return top.groupBy("sheet").agg(F.when(F.count("*") == 1, F.min("system")).otherwise("unknown").alias("system"), F.max("n").alias("n"))


# ---- comparisons


def model_diff(ours: DataFrame, theirs: DataFrame, key: str, role: str, fields: Sequence[str]) -> DataFrame:
    """``(key, status)``: missing, extra, wrong role, fields differ or ok, over all keys of both models."""
    named = lambda df, p: df.select(F.col(key).alias(f"{p}key"), *[F.col(c).alias(f"{p}{c}") for c in (role, *fields)], F.lit(True).alias(f"{p}in"))
    j = named(ours, "a_").join(named(theirs, "b_"), F.col("a_key") == F.col("b_key"), "full")
    differ = reduce(lambda a, b: a | b, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in fields])
    status = F.when(F.col("a_in").isNull(), "extra").when(F.col("b_in").isNull(), "missing").when(~F.col(f"a_{role}").eqNullSafe(F.col(f"b_{role}")), "wrong role").when(differ, "fields differ").otherwise("ok")
    return j.select(F.coalesce("a_key", "b_key").alias(key), status.alias("status"))


def multiset_diff(drawn: DataFrame, modelled: DataFrame, group: str, kind: str) -> DataFrame:
    """The kinds of each group whose numbers differ, with both numbers."""
    a = drawn.groupBy(group, kind).agg(F.count("*").alias("drawn"))
    b = modelled.groupBy(group, kind).agg(F.count("*").alias("modelled"))
    j = a.join(b, [group, kind], "full").select(group, kind, F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("modelled", F.lit(0)).alias("modelled"))
    return j.where("drawn <> modelled")


def claim_check(claims: DataFrame, fields: DataFrame) -> DataFrame:
    """``claims(owner, name, claimed)`` against ``fields(owner, name, held)``: equal, differs or no field."""
    j = claims.join(fields.withColumn("_there", F.lit(True)), ["owner", "name"], "left")
    return j.withColumn("result", F.when(F.col("_there").isNull(), "no field").when(F.col("held").eqNullSafe(F.col("claimed")), "equal").otherwise("differs")).drop("_there")


def name_check(names: DataFrame, sources: DataFrame) -> DataFrame:
    """``names(id, words)`` against ``sources(id, words)``: confirmed by a shared word, corrected, or unverified without a source."""
    j = names.join(sources.select("id", F.col("words").alias("_w")), "id", "left")
    return j.withColumn("result", F.when(F.col("_w").isNull(), "unverified").when(F.arrays_overlap("words", "_w"), "confirmed").otherwise("corrected")).drop("_w")


def shared_networks(members: DataFrame) -> DataFrame:
    """``members(network, sheet, id)``: pairs of one sheet that share exactly one network, and which."""
    m = members.distinct()
    a, b = m.alias("a"), m.alias("b")
    met = a.join(b, (F.col("a.network") == F.col("b.network")) & (F.col("a.sheet") == F.col("b.sheet")) & (F.col("a.id") < F.col("b.id")))
    per = met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count_distinct("a.network").alias("n"), F.min("a.network").alias("network"))
    return per.where("n = 1").select("a", "b", "network")


def movement(readings: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first and last value of each live tag, and whether it moved."""
    at = F.struct(*order)
    return readings.groupBy(*by).agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last")).withColumn("moved", F.col("first") != F.col("last"))


def out_of_range(readings: DataFrame, by: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Samples and those outside the plausible range, reported and not clipped."""
    return readings.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col("value") < lo) | (F.col("value") > hi)).alias("out_of_range"))


def stated_numbers(claims: DataFrame, results: DataFrame, key: str, digits: int) -> DataFrame:
    """Whether each ``claims(key, stated)`` is its ``results(key, value)`` at the stated number of places; null without a result."""
    return claims.join(results, key, "left").select(key, (F.round("value", digits) == F.col("stated")).alias("holds"))


def pair_changes(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` added and removed from one method to another, and whether they are right; order of a pair is of no account."""
    same = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    j = same(before).withColumn("_b", F.lit(True)).join(same(after).withColumn("_a", F.lit(True)), ["a", "b"], "full").where("_a is null or _b is null")
    told = j.join(same(truth).withColumn("_t", F.lit(True)), ["a", "b"], "left")
    return told.select("a", "b", F.when(F.col("_b").isNull(), "added").otherwise("removed").alias("change"), F.coalesce("_t", F.lit(False)).alias("right"))


def regenerated(made: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """``(key, state)``: MATCH, DIFF, GAP (not recorded) or MISSING (not made again), by all other columns."""
    digest = lambda df, n: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"}).cast("binary"), 256).alias(n))
    j = digest(made, "m").join(digest(recorded, "r"), key, "full")
    return j.select(key, F.when(F.col("m").isNull(), "MISSING").when(F.col("r").isNull(), "GAP").when(F.col("m") == F.col("r"), "MATCH").otherwise("DIFF").alias("state"))


def identity_sets(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Ids that are missing from ``found(id)`` or extra in it."""
    a, b = expected.select("id").distinct(), found.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("extra")))


# ---- rollups


def steady_mean(value: str) -> Column:
    """The mean of a double, the same in whatever order rows are added: they are summed as the decimals they print.

    A value that is not nought and lies outside of 0.001 to 1e9, or is not
    finite, has too many digits for that; its group has the ordinary mean.
    """
    v = F.col(value)
    fits = (v == 0) | ((F.abs(v) >= 1e-3) & (F.abs(v) < 1e9))
    total = F.try_sum(F.when(fits, v.cast("decimal(38,20)")))
    return F.when(F.bool_and(fits), total.cast("double") / F.count(v)).otherwise(F.avg(v))


def setpoint_offsets(series: DataFrame, most: float) -> DataFrame:
    """Series ``(.., mean, setpoint)`` whose mean is off its setpoint by more than a share."""
    return series.withColumn("off", F.abs(F.col("mean") - F.col("setpoint")) / F.greatest(F.abs("setpoint"), F.lit(1e-9))).where(F.col("off") > most)


def imbalance(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``flows(.., outlet, quantity)``: what leaves less what enters, as a share of what leaves."""
    signed = F.when(F.col("outlet"), F.col("quantity")).otherwise(-F.col("quantity"))
    leaves = F.sum(F.when(F.col("outlet"), F.col("quantity")).otherwise(0.0))
    return flows.groupBy(*by).agg((F.abs(F.sum(signed)) / F.greatest(F.abs(leaves), F.lit(1e-9))).alias("imbalance"))


def staging_findings(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """``rows(parent, name, type)``: names given twice under a parent, and rows under a parent that ``parents(parent)`` lacks."""
    twice = rows.groupBy("parent", "name", "type").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("finding"), "parent", "n")
    orphan = rows.join(parents, "parent", "left_anti").groupBy("parent").agg(F.count("*").alias("n")).select(F.lit("orphan").alias("finding"), "parent", "n")
    return twice.unionByName(orphan).groupBy("finding", "parent").agg(F.sum("n").alias("n"))


def shared_tags(items: DataFrame) -> DataFrame:
    """The items whose tag, upper case, is on more than one item."""
    several = items.groupBy(F.upper("tag").alias("_u")).agg(F.count("*").alias("_n")).where("_n > 1").select("_u")
    return items.join(several, F.upper(F.col("tag")) == F.col("_u"), "left_semi")


def active_spans(events: DataFrame, by: str, start: Column, order: Sequence[str], most_minutes: float) -> DataFrame:
    """Per ``by`` the minutes from each start to the next event, each at most ``most_minutes``, and how many spans."""
    from millrace.operators.series import micros

    own = events.withColumn("_next", F.lead("ts").over(Window.partitionBy(by).orderBy(*order))).where(start & F.col("_next").isNotNull())
    minutes = F.least(F.lit(float(most_minutes)), (micros("_next") - micros("ts")) / 60e6)
    return own.groupBy(by).agg(F.sum(minutes).alias("active_minutes"), F.count("*").alias("spans"))
