"""Scores of predictions against keys, and statistics over replicates.

Counts are rows: one table of counts per (run, sheet) feeds every metric, and
every rollup is a sum of counts followed by the same ratio.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import numbered

#: Two-sided 95% points of Student's t by degrees of freedom.
T975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 30: 2.042}
Z95 = 1.96


def ratio(a: Column, b: Column, none: float | None = None) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(none).cast("double"))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp, predicted, in_key; 0 where nothing is to be divided."""
    p, r = ratio(F.col("tp"), F.col("predicted"), 0.0), ratio(F.col("tp"), F.col("in_key"), 0.0)
    f1 = F.when(F.col("predicted") + F.col("in_key") > 0, 2.0 * F.col("tp") / (F.col("predicted") + F.col("in_key"))).otherwise(F.lit(0.0))
    return counts.withColumns({"precision": p, "recall": r, "f1": f1})


def counts(matches: DataFrame, preds: DataFrame, keys: DataFrame, run: list[str], on: str) -> DataFrame:
    """Tp, predicted and in_key per run and sheet; a sheet that a run has nothing for counts as empty output."""
    runs = preds.select(*run).distinct()
    in_key = keys.groupBy(on).agg(F.count("*").alias("in_key")).crossJoin(runs)  # runs: a handful of tools
    tp = matches.groupBy(*run, on).agg(F.count("*").alias("tp"))
    predicted = preds.groupBy(*run, on).agg(F.count("*").alias("predicted"))
    out = in_key.join(tp, [*run, on], "left").join(predicted, [*run, on], "left")
    return out.select(*run, on, F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("predicted", F.lit(0)).alias("predicted"), "in_key")


def review_load(counts_: DataFrame) -> DataFrame:
    """Corrections (false, missed) per 100 key items."""
    fixes = (F.col("predicted") - F.col("tp")) + (F.col("in_key") - F.col("tp"))
    return counts_.withColumn("corrections", fixes).withColumn("review_load", ratio(100.0 * fixes, F.col("in_key")))


def rollup(counts_: DataFrame, by: list[str]) -> DataFrame:
    """Micro-average over sheets."""
    return prf(counts_.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "in_key")]))


#: Metrics over summed counts.
METRICS: dict[str, Callable[[], Column]] = {
    "f1": lambda: F.when(F.sum("predicted") + F.sum("in_key") > 0, 2.0 * F.sum("tp") / (F.sum("predicted") + F.sum("in_key"))),
    "recall": lambda: F.when(F.sum("in_key") > 0, F.sum("tp") / F.sum("in_key")),
    "review_load": lambda: F.when(F.sum("in_key") > 0, 100.0 * (F.sum("predicted") + F.sum("in_key") - 2 * F.sum("tp")) / F.sum("in_key")),
}


def atom_scores(truth: DataFrame, given: DataFrame, section: str = "section") -> DataFrame:
    """Fact atoms as rows: hits, missing and unexpected per section and overall (null section)."""
    cols = truth.columns
    both = truth.distinct().withColumn("_t", F.lit(1)).join(given.distinct().withColumn("_g", F.lit(1)), cols, "full")
    sets = both.groupBy(section).agg(*_atom_counts()).unionByName(both.agg(*_atom_counts()).withColumn(section, F.lit(None).cast("string")).select(section, "tp", "predicted", "in_key"))
    return prf(sets)


def _atom_counts() -> list[Column]:
    return [F.count(F.col("_t") + F.col("_g")).alias("tp"), F.count("_g").alias("predicted"), F.count("_t").alias("in_key")]


# ---- statistics


def t975(df: Column) -> Column:
    """The listed value at the largest listed degrees of freedom not above; 1.96 above 30."""
    out = F.lit(None).cast("double")
    for k in sorted(T975):
        out = F.when(df >= k, F.lit(T975[k])).otherwise(out)
    return F.when(df > 30, F.lit(Z95)).otherwise(out)


def run_interval(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and Student interval of replicates; no interval for one."""
    own = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = t975(F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    some = F.col("n") >= 2
    return own.select(*by, "n", "mean", F.when(some, F.col("sd")).alias("sd"), F.when(some, F.col("mean") - half).alias("lo"), F.when(some, F.col("mean") + half).alias("hi"))


def welch(values: DataFrame, by: list[str], arm: str, a: object, b: object, value: str) -> DataFrame:
    """Difference of two arms with Welch's interval; degrees of freedom are truncated; a tie unless it excludes 0."""
    pick = lambda w: F.when(F.col(arm) == w, F.col(value))
    own = values.groupBy(*by).agg(*[f(pick(w)).alias(f"{n}{s}") for s, w in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    va, vb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    se, diff = F.sqrt(va + vb), F.col("ma") - F.col("mb")
    df = (va + vb) * (va + vb) / (va * va / (F.col("na") - 1) + vb * vb / (F.col("nb") - 1))
    half = F.when(se == 0, F.lit(0.0)).otherwise(t975(F.greatest(F.lit(1.0), F.floor(df).cast("double"))) * se)
    enough = (F.col("na") >= 2) & (F.col("nb") >= 2)
    out = own.select(*by, diff.alias("diff"), F.when(enough, diff - half).alias("lo"), F.when(enough, diff + half).alias("hi"))
    return out.withColumn("verdict", F.when(F.col("lo") > 0, "a").when(F.col("hi") < 0, "b").otherwise("tie"))


def bootstrap(counts_: DataFrame, metric: str, draws: int, seed: str, replicate: str = "tool", unit: str = "sheet") -> DataFrame:
    """Two-stage resampling: units with replacement, and a random replicate of each; 2.5 and 97.5 percent points.

    The pick of a draw and slot is a hash of both, so any engine repeats it.
    Draws times units rows are made and summed in one shuffle by draw.
    """
    spark = counts_.sparkSession
    units = numbered(counts_.select(unit).distinct(), unit, "u")
    n = units.count()
    reps = numbered(counts_.select(replicate).distinct(), replicate, "r")
    m = reps.count()
    if not n:
        return spark.createDataFrame([], "draws long, lo double, hi double")
    pick = lambda what, k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(what), "draw", "slot").cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("int")
    slots = spark.range(draws * n).select(F.floor(F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("slot"))
    picked = slots.select("draw", pick("unit", n).alias("u"), pick("rep", m).alias("r"))
    rows = picked.join(units, "u").join(reps, "r").join(counts_, [unit, replicate], "left")
    values = rows.groupBy("draw").agg(METRICS[metric]().alias("value"))
    return values.agg(F.count("*").alias("draws"), F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k of n; null for n = 0."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def caught(rated: DataFrame, share: float, by: list[str]) -> DataFrame:
    """Expected share of errors in the riskiest part of each group; equal risks share what is left of it.

    Rows are first counted per risk, so a window runs over distinct risks.
    """
    per = rated.groupBy(*by, "risk").agg(F.count("*").alias("n"), F.sum("wrong").alias("errors"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("n").over(whole.orderBy(F.desc("risk")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = share * F.sum("n").over(whole)
    took = F.least(F.col("n").cast("double"), F.greatest(F.lit(0.0), k - before)) * F.col("errors") / F.col("n")
    return per.withColumn("took", took).groupBy(*by).agg(F.sum("took").alias("_t"), F.sum("errors").alias("errors")).select(*by, "errors", ratio(F.col("_t"), F.col("errors")).alias("caught"))


def green_cut(rated: DataFrame, by: list[str], most_rate: float = 0.05) -> DataFrame:
    """The largest risk up to which the running error rate stays within bounds."""
    per = rated.groupBy(*by, "risk").agg(F.count("*").alias("n"), F.sum("wrong").alias("errors"))
    order = Window.partitionBy(*by).orderBy("risk").rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("rate", F.sum("errors").over(order) / F.sum("n").over(order))
    return run.groupBy(*by).agg(F.max(F.when(F.col("rate") <= most_rate, F.col("risk"))).alias("green_max"))


def logistic_nonnegative(rows: DataFrame, features: list[str], label: str, ridge: float = 1.0) -> dict[str, float]:
    """Ridge logistic fit with weights of at least 0 and a free intercept; a weight a feature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    n = max(1, rows.count())
    data = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", F.col(label).cast("double").alias("label"))
    fit = LogisticRegression(regParam=ridge / n, elasticNetParam=0.0, standardization=False, maxIter=100, lowerBoundsOnCoefficients=Matrices.dense(1, len(features), [0.0] * len(features)))
    model = fit.fit(data)
    return dict(zip(features, model.coefficients.toArray().tolist(), strict=True)) | {"intercept": float(model.intercept)}


def risk_tiers(rows: DataFrame, weights: dict[str, float], green_max: float, red_min: float) -> DataFrame:
    """Risk, tier and the three signals that raise it most; unrated (null) rows are amber."""
    parts = [F.struct((F.lit(w) * F.col(f)).alias("v"), F.lit(f).alias("name")) for f, w in weights.items() if f != "intercept"]
    z = sum((F.lit(w) * F.col(f) for f, w in weights.items() if f != "intercept"), F.lit(weights.get("intercept", 0.0)))
    risk = F.lit(1.0) / (1 + F.exp(-z))
    tier = F.when(F.col("risk").isNull(), "amber").when(F.col("risk") < green_max, "green").when(F.col("risk") >= red_min, "red").otherwise("amber")
    top = F.slice(F.reverse(F.array_sort(F.filter(F.array(*parts), lambda x: x["v"] > 0.25))), 1, 3)
    return rows.withColumn("risk", risk).withColumn("tier", tier).withColumn("why", F.array_join(F.transform(top, lambda x: x["name"]), "; "))


def allocation(strata: DataFrame, n: int, floor: int = 2) -> DataFrame:
    """Rows to draw from each ``strata(stratum, size)``: at least ``floor``, the rest in proportion, largest remainders first.

    One row a stratum; remainders are handed out by rank in one pass.
    """
    whole = Window.partitionBy()
    base = strata.withColumn("least", F.least(F.lit(floor), F.col("size"))).withColumn("room", F.col("size") - F.col("least"))
    left = F.greatest(F.lit(0), F.least(F.lit(n), F.sum("size").over(whole)) - F.sum("least").over(whole))
    want = base.withColumn("want", F.when(F.sum("room").over(whole) > 0, left * F.col("room") / F.sum("room").over(whole)).otherwise(F.lit(0.0)))
    want = want.withColumn("whole", F.floor("want")).withColumn("spare", (left - F.sum("whole").over(whole)).cast("long"))
    place = F.row_number().over(Window.orderBy((F.col("want") - F.col("whole")).desc(), "stratum"))
    return want.withColumn("take", F.least(F.col("size"), F.col("least") + F.col("whole") + (place <= F.col("spare")).cast("int"))).select("stratum", "size", F.col("take").cast("long").alias("take"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """The rows with the lowest hashes of each stratum, and the population weight of each."""
    sizes = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("size"))
    plan = allocation(sizes, n)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), key))
    ranked = rows.withColumn("_place", place).join(plan, F.col(stratum) == F.col("stratum"))
    return ranked.where("_place <= take").withColumn("weight", F.col("size") / F.col("take")).drop("_place", "take", "size")
