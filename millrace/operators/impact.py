"""What a change saves, as ranges carried through derivations.

A change is a set of named ranges. Rules say how one name follows from others;
they are put in order once and become column expressions, so all changes are
resolved in one pass over the rows without a shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_POINTS = 200
RANGE = "struct<lo: double, hi: double>"


class Rule(NamedTuple):
    """``name`` is left ``op`` right; op is one of + - * /, right a name or a number."""

    name: str
    left: str
    op: str
    right: str | float


#: Energy, cost and emissions of electricity, fuel and steam changes; 0.7457 kW a horsepower, 1e6 Btu a MMBtu (fixed values).
RULES = (
    Rule("kw", "hp", "*", 0.7457),
    Rule("kw", "kw_before", "-", "kw_after"),
    Rule("kwh", "kw", "*", "hours"),
    Rule("btu_per_lb", "steam_btu_per_lb", "-", "feedwater_btu_per_lb"),
    Rule("heat_mmbtu", "btu", "/", 1e6),
    Rule("btu", "lb", "*", "btu_per_lb"),
    Rule("lb", "lb_per_h", "*", "hours"),
    Rule("fuel_mmbtu", "heat_mmbtu", "/", "boiler_efficiency"),
    Rule("cost_electricity", "kwh", "*", "price_per_kwh"),
    Rule("cost_fuel", "fuel_mmbtu", "*", "price_per_mmbtu"),
    Rule("co2e_electricity", "kwh", "*", "kg_per_kwh"),
    Rule("co2e_fuel", "fuel_mmbtu", "*", "kg_per_mmbtu"),
)


def in_order(rules: Sequence[Rule]) -> list[tuple[str, list[Rule]]]:
    """Names with their rules, each after the names it needs; a circle is an error."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.name, []).append(r)
    out: list[tuple[str, list[Rule]]] = []
    done: set[str] = set()
    while len(done) < len(by):
        ready = [n for n in by if n not in done and all(x not in by or x in done for r in by[n] for x in (r.left, r.right))]
        if not ready:
            raise ValueError(f"the rules of {', '.join(sorted(set(by) - done))} need each other")
        for n in ready:
            out.append((n, by[n]))
        done |= set(ready)
    return out


def _of(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def combined(a: Column, op: str, b: Column) -> Column:
    """``a op b`` of two ranges; null where one is null or a divisor holds zero."""
    both = a.isNotNull() & b.isNotNull()
    if op == "+":
        return F.when(both, _of(a["lo"] + b["lo"], a["hi"] + b["hi"]))
    if op == "-":
        return F.when(both, _of(a["lo"] - b["hi"], a["hi"] - b["lo"]))
    if op == "/":
        both = both & ~((b["lo"] <= 0) & (b["hi"] >= 0))
        whole = F.when(both, b)
        ends = [a[x] / whole[y] for x in ("lo", "hi") for y in ("lo", "hi")]
    elif op == "*":
        ends = [a[x] * b[y] for x in ("lo", "hi") for y in ("lo", "hi")]
    else:
        raise ValueError(f"unknown operation {op!r}")
    return F.when(both, _of(F.least(*ends), F.greatest(*ends)))


def interpolated(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """The range of a rising table over the range ``x``, linear between its ``points``; null outside of them."""
    if not 2 <= len(points) <= MOST_POINTS or any(p[0] >= q[0] or p[1] > q[1] for p, q in zip(points, points[1:], strict=False)):
        raise ValueError(f"a table has 2 to {MOST_POINTS} points that rise")

    def at(v: Column) -> Column:
        out = F.when(v == points[0][0], F.lit(float(points[0][1])))
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            out = out.when((v > x0) & (v <= x1), F.lit(float(y0)) + (v - x0) * ((y1 - y0) / (x1 - x0)))
        return out

    lo, hi = at(x["lo"]), at(x["hi"])
    return F.when(lo.isNotNull() & hi.isNotNull(), _of(lo, hi))


def resolved(changes: DataFrame, rules: Sequence[Rule] = RULES, tables: dict[str, tuple[str, Sequence[tuple[float, float]]]] | None = None) -> DataFrame:
    """``changes`` with ``known`` (every name's range) and ``refused`` (why a change counts for nothing, empty if it does).

    ``changes`` has a column ``given``, a map of names to ranges; ``tables``
    give a name as a table's value at another one (steam by its pressure). A
    given range stands, and a derived one must agree with it and with those of
    other rules to a millionth; if not, the change is refused, and so it is
    for a range whose low is above its high or not finite, a divisor that
    holds zero, and a value outside its table.
    """
    bad = lambda v: v["lo"].isNull() | v["hi"].isNull() | F.isnan(v["lo"]) | F.isnan(v["hi"]) | (F.abs(v["lo"]) == float("inf")) | (F.abs(v["hi"]) == float("inf")) | (v["lo"] > v["hi"])
    out = changes.withColumn("_why", F.transform(F.map_keys(F.map_filter("given", lambda _, v: v.isNull() | bad(v))), lambda k: F.concat(F.lit("not a range: "), k)))
    names = {n for r in rules for n in (r.name, r.left, r.right) if isinstance(n, str)} | {n for t, (x, _) in (tables or {}).items() for n in (t, x)}
    for n in sorted(names):
        v = F.col("given").getItem(n)
        out = out.withColumn(f"_v_{n}", F.when(~bad(v), v).cast(RANGE))
    for n, (x, points) in (tables or {}).items():
        found = interpolated(F.col(f"_v_{x}"), points)
        missed = F.col(f"_v_{x}").isNotNull() & found.isNull()
        out = _settled(out.withColumn("_why", F.when(missed, F.array_append("_why", F.lit(f"outside the table: {n}"))).otherwise(F.col("_why"))), n, [found])
    for n, own in in_order(rules):
        found = []
        for r in own:
            b = F.col(f"_v_{r.right}") if isinstance(r.right, str) else _of(F.lit(r.right), F.lit(r.right))
            a = F.col(f"_v_{r.left}")
            if r.op == "/":
                zero = a.isNotNull() & (b["lo"] <= 0) & (b["hi"] >= 0)
                out = out.withColumn("_why", F.when(zero, F.array_append("_why", F.lit(f"division by zero: {n}"))).otherwise(F.col("_why")))
            found.append(combined(a, r.op, b))
        out = _settled(out, n, found)
    known = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in sorted(names)]), F.array(*[F.col(f"_v_{n}") for n in sorted(names)])), lambda _, v: v.isNotNull())
    return out.select(*changes.columns, known.alias("known"), F.array_sort(F.array_distinct("_why")).alias("refused"))


def _settled(df: DataFrame, name: str, found: list[Column]) -> DataFrame:
    """The value of ``name``: given or derived, and a refusal where these differ."""
    every = F.filter(F.array(F.col(f"_v_{name}"), *[f.cast(RANGE) for f in found]), lambda x: x.isNotNull())
    close = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.lit(1e-12), F.abs(a), F.abs(b))
    df = df.withColumn("_all", every)
    first = F.get("_all", F.lit(0))
    differs = F.exists("_all", lambda x: ~(close(x["lo"], F.get(F.col("_all"), F.lit(0))["lo"]) & close(x["hi"], F.get(F.col("_all"), F.lit(0))["hi"])))
    return df.withColumns({f"_v_{name}": first, "_why": F.when(differs, F.array_append("_why", F.lit(f"derived in two ways: {name}"))).otherwise(F.col("_why"))}).drop("_all")


def totals(changes: DataFrame, by: Sequence[str], measures: Sequence[str] = ("kwh", "fuel_mmbtu", "cost_electricity", "cost_fuel", "co2e_electricity", "co2e_fuel")) -> DataFrame:
    """``(by, measure, changes, refused, lo, hi)``: sums of each measure over the changes of ``resolved`` that were not refused; changes counts those that have it."""
    each = changes.select(*by, (F.size("refused") > 0).alias("bad"), F.explode(F.array(*map(F.lit, measures))).alias("measure"), "known")
    v = F.when(~F.col("bad"), F.element_at(F.col("known"), F.col("measure")))
    return each.withColumn("v", v).groupBy(*by, "measure").agg(F.count("v").alias("changes"), F.count_if("bad").alias("refused"), F.sum("v.lo").alias("lo"), F.sum("v.hi").alias("hi"))
