"""Listed identifiers inside tags. J09: which system and drawing number a sheet has."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import written

GRAM = 3
#: Pairs of a sheet and a number that one task goes through in their order, a round (fixed).
BLOCK = 1 << 17
#: Best pairs of a sheet that are looked at to learn which numbers may be taken, before more are (fixed).
NEAR = 64
#: Sheets whose best pairs a task holds at once (fixed).
SHEETS = 512


def _grams(text: Column, size: int) -> Column:
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))))


def contained(listed: DataFrame, tags: DataFrame, on: list[str]) -> DataFrame:
    """``listed(on, identifier, class)`` with hits, found and class_agrees: the ``tags(on, tag, class)`` of the same ``on`` that contain the identifier.

    Tags are indexed by their pieces of three letters (one or two where an
    identifier is that short). Each identifier meets the tags that have its
    rarest piece there and is then looked for in them, so the pairs follow the
    hits and not the product of both tables. Texts are compared as they are;
    empty or null identifiers are not found; tags that repeat count each, and
    so do rows of the list.
    """
    names = listed.select(*on, "identifier").where("identifier <> ''").distinct()
    size = F.least(F.length("identifier"), F.lit(GRAM))
    of_size = lambda text, n: F.when(n == 1, _grams(text, 1)).when(n == 2, _grams(text, 2)).otherwise(_grams(text, 3))
    asked = written(names.select(*on, "identifier", F.explode(of_size(F.col("identifier"), size)).alias("piece")), "asked")
    own = tags.where("tag <> ''").groupBy(*on, "tag", "class").agg(F.count("*").alias("n"))
    lengths = [r[0] for r in asked.select(F.length("piece")).distinct().collect()]  # three rows at most
    every = F.flatten(F.array(*[F.coalesce(_grams(F.col("tag"), n), F.array().cast("array<string>")) for n in sorted(lengths)])) if lengths else F.array().cast("array<string>")
    index = own.select(*on, "tag", "class", "n", F.explode(every).alias("piece"))
    index = written(index.join(asked.select(*on, "piece").distinct(), [*on, "piece"], "left_semi"), "index")
    common = index.groupBy(*on, "piece").agg(F.count("*").alias("tags"))
    rarest = asked.join(common, [*on, "piece"], "left").groupBy(*on, "identifier").agg(F.min(F.struct(F.coalesce("tags", F.lit(0)).alias("tags"), "piece")).alias("m")).where("m.tags > 0").select(*on, "identifier", "m.piece")
    met = rarest.join(index, [*on, "piece"]).where(F.contains("tag", "identifier"))
    found = met.groupBy(*on, "identifier").agg(F.sum("n").alias("hits"), F.collect_set("class").alias("classes"))
    out = listed.join(found, [*on, "identifier"], "left")
    agrees = F.coalesce(F.array_contains("classes", F.col("class")), F.lit(False))
    return out.select(*listed.columns, F.coalesce("hits", F.lit(0)).alias("hits"), F.col("hits").isNotNull().alias("found"), agrees.alias("class_agrees"))


def _up_to(due: DataFrame, block: int) -> Column | None:
    """The condition that holds for about the first ``block`` pairs of ``due``, whole equal ones of a sheet at a time; null without a pair."""
    levels = due.groupBy("v", "o").agg(F.count("*").alias("n")).orderBy(F.desc("v"), F.desc("o")).limit(1000).collect()
    if not levels:
        return None
    seen, last = 0, None
    for r in levels:
        if seen + r.n > block:
            break
        seen, last = seen + r.n, r
    whole = F.lit(False) if last is None else (F.col("v") > last.v) | ((F.col("v") == last.v) & (F.col("o") >= last.o))
    if last is levels[-1]:
        return whole
    cut = levels[0 if last is None else levels.index(last) + 1]
    at = (F.col("v") == cut.v) & (F.col("o") == cut.o)
    until = None
    for s in due.where(at).groupBy("sheet").agg(F.count("*").alias("n")).orderBy("sheet").limit(5000).collect():
        if until is not None and seen + s.n > block:
            break
        seen, until = seen + s.n, s.sheet
    return whole | (at & (F.col("sheet") <= F.lit(until)))


def _in_turn(rows: DataFrame) -> DataFrame:
    """``(sheet, number, via)``: numbers given, and sheets with a null number that are ambiguous or wait for one, of ``rows`` that one task goes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        taken, given, over, out = set(), set(), {}, {}
        for (due, _, _, sheet), own in groupby(every, key=lambda r: r[:4]):
            free = [r for r in own if r[4] not in taken]
            if sheet in given or not free:
                continue
            behind = over.setdefault(sheet, [])
            while behind and behind[-1] in taken:
                behind.pop()
            if due and not behind and len(free) == 1:
                given.add(sheet)
                taken.add(free[0][4])
                out[sheet] = free[0][4:]
            else:
                behind += [r[4] for r in free]
                out[sheet] = (None, None)
        yield pa.RecordBatch.from_pylist([{"sheet": s, "number": n, "via": via} for s, (n, via) in out.items()], schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    own = rows.select("due", "v", "o", "sheet", "number", "via").repartition(1).sortWithinPartitions("due", F.desc("v"), F.desc("o"), "sheet", "number")
    kinds = rows.select("sheet", "number", "via").schema
    schema = to_arrow_schema(kinds)
    return own.mapInArrow(run, kinds)


def _sure(rows: DataFrame) -> DataFrame:
    """The numbers that a sheet could get if all others seen in its task were taken; ``rows(sheet, cut, pairs)`` have the best pairs of a sheet in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set = set()
        level = lambda pair: (pair["v"], pair["o"])
        for batch in (b.slice(at, SHEETS) for b in batches for at in range(0, len(b), SHEETS)):
            new: list = []
            unsettled = [(own[::-1], cut) for own, cut in zip(batch.column("pairs").to_pylist(), batch.column("cut").to_pylist(), strict=True)]
            more = True
            while more:
                more, still = False, []
                for own, cut in unsettled:
                    while own and own[-1]["number"] in found:
                        own.pop()
                    if not own:
                        continue
                    # Where pairs were cut off, the last ones shown may have equals.
                    if any(level(x) == level(own[-1]) and x["number"] not in found for x in own[:-1]) or (cut and level(own[0]) == level(own[-1])):
                        still.append((own, cut))
                        continue
                    new.append(own.pop()["number"])
                    found.add(new[-1])
                    still.append((own, cut))
                    more = True
                unsettled = still
            if new:
                yield pa.RecordBatch.from_pydict({"number": new}, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = rows.select(F.col("pairs")[0]["number"].alias("number")).schema
    schema = to_arrow_schema(kind)
    return rows.select("cut", "pairs").mapInArrow(run, kind)


def contested(pairs: DataFrame, most: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """Of ``pairs(sheet, number, v, o)``: the numbers that may be taken at all, and ``(sheet, v, o)`` of the best pairs of a sheet whose numbers never are.

    A number is only taken by a sheet whose other numbers of its rank or a
    better one are gone. So what may be taken follows from the sheets whose
    best number has no equal, then from those whose best one without these has
    none, and so on; it is more than what is taken, as no order is heeded. A
    sheet gets nothing at or below its best pair whose number stays.

    Each sheet shows its best ``most`` pairs; those that used them up show more.
    """
    best = Window.partitionBy("sheet").orderBy(F.desc("v"), F.desc("o"), "number")
    all_taken = pairs.select("number").limit(0)
    while True:
        rest = pairs.join(all_taken, "number", "left_anti")
        near = written(rest.select("sheet", "number", "v", "o", F.row_number().over(best).alias("place")).where(F.col("place") <= most + 1), "near")
        # The pair behind the last one shown only tells that there is one.
        near = near.withColumn("cut", F.max("place").over(Window.partitionBy("sheet")) > most).where(F.col("place") <= most)
        before = all_taken
        while True:
            own = near.join(all_taken, "number", "left_anti").groupBy("sheet", "cut").agg(F.sort_array(F.collect_list(F.struct("place", "v", "o", "number"))).alias("pairs"))
            new = written(_sure(own).distinct(), "sure")
            if new.isEmpty():
                break
            all_taken = written(all_taken.unionByName(new), "contested")
        left = near.join(all_taken.withColumn("gone", F.lit(True)), "number", "left")
        short = left.groupBy("sheet", "cut").agg(F.count_if(F.col("gone").isNull()).alias("shown")).where("cut and shown < 2")
        if all_taken is before or short.isEmpty():
            stays = left.where("gone is null").groupBy("sheet").agg(F.max(F.struct("v", "o")).alias("m"))
            return all_taken, stays.select("sheet", "m.v", "m.o")


def sheet_identity(tags: DataFrame, refs: DataFrame, register: DataFrame, most_rounds: int = 1000, block: int = BLOCK) -> DataFrame:
    """``(sheet, system_code, system_code_method, drawing_number, drawing_number_method, candidates)`` of every sheet of ``tags``.

    ``tags(sheet, code)`` has the system code of each equipment tag, null
    without one; ``refs(sheet, code, number)`` the off-page references, code
    null where they give none; ``register(sheet, system_code, drawing_number)``
    wins. Else the code is the most frequent one (of several the smallest,
    ``tie``), and a number is inferred: one that references pair with a most
    frequent code of the sheet and that the sheet does not point to, rated by
    the tags with that code, then by the other sheets that point to it.

    Numbers are given one to one, the best pair first. A sheet whose two best
    numbers left are equal is ambiguous when its turn comes. A number settles
    a tie of codes.

    Numbers that no sheet can ever take (``contested``) hold the sheets back
    that see them for good, so only the pairs above those are gone through.
    Where many sheets could have the same numbers, their pairs hang together
    one after the other. So a round takes the first ``block`` pairs, and one
    task goes through them in turn; sheets that got a number and numbers that
    were taken drop out with all their pairs. Every eighth round settles,
    all at once, the pairs that no open pair before them can touch: those that
    share its sheet or a number that its sheet could have. Thus neither few
    numbers for many sheets nor many sheets apart from each other make many
    rounds.
    """
    sheets = tags.select("sheet").distinct()
    counts = written(tags.where("code is not null").groupBy("sheet", "code").agg(F.count("*").alias("n")), "codes")
    most = counts.groupBy("sheet").agg(F.max("n").alias("top"))
    leading = written(counts.join(most, "sheet").where("n = top").select("sheet", "code", "top"), "leading")
    named = leading.groupBy("sheet").agg(F.min("code").alias("code"), F.count("*").alias("same"))
    pointed = written(refs.where("number is not null").select("sheet", "code", "number").distinct(), "refs")
    known = register.select("sheet", F.col("system_code").alias("reg_code"), F.col("drawing_number").alias("reg_number"))
    paired = pointed.where("code is not null").select("code", "number").distinct()
    own = pointed.select("sheet", "number").distinct()
    rated = leading.join(paired, "code").join(own, ["sheet", "number"], "left_anti").join(known.where("reg_number is not null"), "sheet", "left_anti")
    rated = rated.groupBy("sheet", "number").agg(F.sum("top").alias("v"), F.max("code").alias("via"))
    by = own.groupBy("number").agg(F.count("*").alias("o"))  # the sheet itself is not among them
    scored = written(rated.join(by, "number").select("sheet", "number", "v", "o", "via"), "scored")

    rank = F.struct((-F.col("v")).alias("v"), (-F.col("o")).alias("o"), "sheet", "number")
    taken = register.where("drawing_number is not null").select(F.col("drawing_number").alias("number")).distinct()
    free = written(scored.join(taken, "number", "left_anti"), "free")
    may, stays = contested(free)
    stays = written(stays, "stays")
    above = free.join(may, "number", "left_semi").join(stays.select("sheet", F.struct("v", "o").alias("stays")), "sheet", "left").where(F.col("stays").isNull() | (F.struct("v", "o") > F.col("stays")))
    left = written(above.select(*scored.columns).withColumn("due", F.lit(True)), "left")
    gave: list[DataFrame] = []
    unsure: list[DataFrame] = [stays.select("sheet")]
    for k in range(most_rounds):
        # Pairs whose turn is over stay as candidates of their sheet as long as their number is free.
        due = left.where("due")
        upto = _up_to(due, block)
        if upto is None:
            break
        if k % 8 < 7:
            first = due.where(upto)
            numbers = first.select("number").distinct().withColumn("now", F.lit(True))
            # Pairs whose turn is over hold their sheet back: for good, if nothing of this block can take their number.
            behind = left.where("not due").join(first.select("sheet").distinct(), "sheet", "left_semi").join(numbers, "number", "left")
            behind = written(behind.select(*left.columns, "now"), "behind")
            rows = first.unionByName(behind.drop("now")).join(behind.where("now is null").select("sheet").distinct(), "sheet", "left_anti")
            turn = written(_in_turn(rows), "turn")
            won = turn.where("number is not null")
            unsure.append(turn.where("number is null").select("sheet"))
            over = F.col("due") & ~upto
        else:
            left = left.withColumn("rank", rank)
            due = left.where("due")
            first = due.groupBy("number").agg(F.min("rank").alias("first"))
            bound = left.join(first, "number").groupBy("sheet").agg(F.min("first").alias("bound"))
            best = left.groupBy("sheet").agg(F.min("rank").alias("best"))
            equal = left.join(best, "sheet").where("v = -best.v and o = -best.o").groupBy("sheet").agg(F.count("*").alias("equal"))
            turn = due.join(bound, "sheet").where(F.col("rank") <= F.col("bound")).join(best, "sheet").join(equal, "sheet")
            turn = written(turn.withColumn("won", (F.col("equal") == 1) & (F.col("rank") == F.col("best"))).select("sheet", "number", "via", "won", "equal"), "turn")
            won = turn.where("won").select("sheet", "number", "via")
            unsure.append(turn.where("equal > 1").select("sheet"))
            left = left.join(turn.select("sheet", "number", F.lit(True).alias("over")), ["sheet", "number"], "left")
            over = F.col("due") & F.col("over").isNull()
        gave.append(won)
        rest = left.join(won.select("sheet"), "sheet", "left_anti").join(won.select("number"), "number", "left_anti")
        left = written(rest.withColumn("due", over).select(*scored.columns, "due"), "left")
    else:
        raise RuntimeError(f"sheet numbers did not settle in {most_rounds} rounds")
    none = scored.select("sheet", "number", "via").limit(0)
    given, tied = none, none.select("sheet")
    for x in gave:
        given = given.unionByName(x)
    for x in unsure:
        tied = tied.unionByName(x)
    given = given.withColumnRenamed("number", "inferred")
    listed = scored.groupBy("sheet").agg(F.array_sort(F.collect_set("number")).alias("candidates"))
    out = sheets.join(named, "sheet", "left").join(known, "sheet", "left").join(given, "sheet", "left").join(tied.distinct().withColumn("tied", F.lit(True)), "sheet", "left").join(listed, "sheet", "left")
    settled = F.col("via").isNotNull() & (F.col("same") > 1)
    code = F.coalesce("reg_code", F.when(settled, F.col("via")), "code")
    code_method = F.when(F.col("reg_code").isNotNull(), "register").when(F.col("code").isNull(), "none").when(settled, "tag prefix and references").when(F.col("same") > 1, "tag prefix, tie").otherwise("tag prefix")
    method = F.when(F.col("reg_number").isNotNull(), "register").when(F.col("inferred").isNotNull(), "references").when(F.col("tied"), "ambiguous").otherwise("unknown")
    return out.select("sheet", code.alias("system_code"), code_method.alias("system_code_method"), F.coalesce("reg_number", "inferred").alias("drawing_number"), method.alias("drawing_number_method"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
